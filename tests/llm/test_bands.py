"""Bands of the quality rules on texts that are only a little off."""

import random

from tests.llm.helpers import PROSE
from webloam.llm import fertility


def test_tails_reject_texts_of_few_words_said_again(spark):
    rng = random.Random(4)
    vocabulary = PROSE.split()
    usual = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(130, 250))), "en") for k in range(300)]
    few = [(1000 + k, " ".join(rng.choice(vocabulary[:24]) for _ in range(rng.randint(130, 250))), "en") for k in range(8)]
    rows = fertility.quality_rules(spark.createDataFrame(usual + few, "doc_id long, text string, lang string")).collect()
    assert not any(r.base_failed for r in rows)
    assert sum(not r.kept for r in rows if r.doc_id >= 1000) == 8
    assert sum(not r.kept for r in rows if r.doc_id < 1000) <= 30


def test_measures_and_bands_equal_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    import sentencepiece

    rng = random.Random(7)
    vocabulary = PROSE.split() + ["漢字", "ñandú", "#x", "|"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((12, 40, 150, 400)) + rng.randint(0, 20))), rng.choice(["en", "en", "en", None]))
            for k in range(500)]
    docs += [(1000 + k, " ".join("".join(rng.choice("qxzvk0~%") for _ in range(6)) for _ in range(rng.randint(60, 70))), "en") for k in range(9)]
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.piece_path())
    want, groups, wholes = {}, defaultdict(list), defaultdict(list)
    for i, text, lang in docs:
        words = text.split()
        ids = [t for w in words for t in model.encode(w)]
        share = [n / len(ids) for n in Counter(ids).values()]
        m = (sum(map(len, words)) / len(ids), sum(model.id_to_piece(t).startswith("<0x") for t in ids) / len(ids),
             -sum(p * math.log(p) for p in share) / math.log(len(ids)))
        windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want[i] = (len(words), m, failed, lang or "", int(math.log2(len(words))))
        if not failed:
            groups[lang or "", want[i][4]].append((len(words), m))
            wholes[lang or ""].append((len(words), m))

    def quartiles(values):
        values = sorted(values)
        return [values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.5, 0.75)]

    rows = fertility.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), fence=fertility.FENCES)
    assert rows.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for r in rows.collect():
        n, m, failed, lang, k = want[r.doc_id]
        assert (r.n_words, r.base_failed, r.lang) == (n, failed, lang)
        assert all(abs(a - b) < 1e-9 for a, b in zip(m, (r.chars_per_token, r.byte_share, r.token_entropy)))
        if failed:
            assert not r.kept
            continue
        own = groups[lang, k]
        noise = 1.0
        if len(own) < fertility.LEAST:
            own = wholes[lang]
            noise = max(1.0, math.sqrt(quartiles([x[0] for x in own])[1] / n))
        inside = True
        for j in range(3):
            q1, mid, q3 = quartiles([x[1][j] for x in own])
            wide = max(q3 - q1, abs(mid) / 100, 0.01) * noise
            inside &= q1 - fertility.FENCES[0] * wide <= m[j] <= q3 + fertility.FENCES[1] * wide
        assert r.kept == inside, (r, inside)
    assert sum(not r.kept for r in rows.collect() if r.doc_id >= 1000) == 9
