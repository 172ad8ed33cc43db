"""Quality rules and the perplexity classifier."""

import math
import random
from collections import Counter, defaultdict

from tests.llm.helpers import PROSE, no_documents, odd_documents
from webloam.llm import common, fertility, kneser_ney


def repeats(words, size=5):
    places = defaultdict(list)
    for k in range(len(words) - size + 1):
        places[tuple(words[k:k + size])].append(k)
    return len({k + i for own in places.values() if len(own) > 1 for k in own for i in range(size)})


def test_repeated_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert fertility.repeated_words(words) == repeats(words)


def test_base_counts():
    words, counts = fertility.base_counts("a #b c\n\n  \nx\na #b c\n <|>\nx\x1cy")
    assert words == ["a", "#b c", "x", "a", "#b c", "<|>", "x\x1cy"] or [w.decode() for w in words] == [
        "a", "#b c", "x", "a", "#b c", "<|>", "x\x1cy"]
    assert counts == (7, sum(len(w.decode()) for w in words), 5, 1, 0)


def test_rules_keep_usual_texts_and_bear_odd_ones(spark):
    rng = random.Random(3)
    vocabulary = PROSE.split()
    usual = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 400))), "en") for k in range(100, 300)]
    docs = odd_documents(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(
        [*usual, (300, "Qzxv0#9@kk=\\%" * 60 + " " + " ".join(f"{k}~{k}" for k in range(60)), "en")], "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in fertility.quality_rules(docs).collect()}
    assert all(rows[k].kept for k, _, _ in usual)
    assert not rows[300].base_failed and not rows[300].kept
    assert rows[3].n_words == rows[4].n_words == rows[5].n_words == 0 and not rows[3].kept
    assert rows[6].base_failed and rows[6].n_repeat_words == 60_000
    assert fertility.quality_rules(odd_documents(spark)).count() == odd_documents(spark).count()
    assert fertility.quality_rules(no_documents(spark)).count() == 0


def model(texts, order, n_symbols):
    """Interpolated modified Kneser-Ney, straight from its formulas."""
    rows = [list(kneser_ney.symbols(t)) for t in texts]
    top = Counter(tuple(r[k - order + 1:k + 1]) for r in rows for k in range(order - 1, len(r)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g, c in counts[n + 1].items() if c > 0)
    cut = {}
    for n, own in counts.items():
        n1, n2, n3, n4 = (sum(c == k for c in own.values()) for k in range(1, 5))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            cut[n] = [0, *(min(max(k - (k + 1) * y * b / a, 0.1), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
        else:
            cut[n] = [0, 0.5, 1, 1.5]
    total, back = defaultdict(int), defaultdict(float)
    for n, own in counts.items():
        for g, c in own.items():
            total[n, g[:-1]] += c
            back[n, g[:-1]] += cut[n][min(c, 3)]

    def p(g):
        if not g:
            return 1 / n_symbols
        n, lower = len(g), p(g[1:])
        if not total[n, g[:-1]]:
            return lower
        c = counts[n].get(g, 0)
        return (max(c - cut[n][min(c, 3)], 0) + back[n, g[:-1]] * lower) / total[n, g[:-1]]

    return p


def test_perplexities_equal_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_CHARS", 600)  # many blocks, in several parts
    monkeypatch.setattr(kneser_ney, "PART_CHARS", 200)
    rng = random.Random(5)
    vocabulary = PROSE.split()
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))), "en") for k in range(60)] + [(60, None, "en"), (61, "Ünïcode 漢字", "en"), (62, "no model", "xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "doc_id long")
    rows = {r.id: r for r in kneser_ney.perplexities(frame, trusted).collect()}
    held = {k for k, r in rows.items() if r.held_out}
    assert held and held < set(range(0, 60, 2))
    p = model([t for k, t, lang in docs if k % 2 == 0 and k < 60 and k not in held], kneser_ney.ORDER, kneser_ney.SYMBOLS)
    for k, text, lang in docs[:62]:
        s = list(kneser_ney.symbols(text or ""))
        nats = -sum(math.log(p(tuple(s[i - kneser_ney.ORDER + 1:i + 1]))) for i in range(kneser_ney.ORDER - 1, len(s)))
        want = math.exp(nats / (len(s) - kneser_ney.ORDER + 1))
        assert math.isclose(rows[k].perplexity, want, rel_tol=1e-4), k
    assert rows[62].perplexity is None


def test_probabilities_sum_to_one():
    p = model(["abracadabra", "abba"], kneser_ney.ORDER, kneser_ney.SYMBOLS)
    context = tuple(kneser_ney.symbols("abr"))[-4:-1]
    assert math.isclose(sum(p((*context, s)) for s in range(kneser_ney.SYMBOLS)), 1, rel_tol=1e-9)


def test_classifier_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(8)
    vocabulary = PROSE.split()
    prose = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 80))), "en") for k in range(300)]
    noise = [(1000 + k, "".join(rng.choice("#$%&*QXZ!") for _ in range(300)), "en") for k in range(10)]
    docs = spark.createDataFrame(prose + noise, "doc_id long, text string, lang string").unionByName(odd_documents(spark).select("doc_id", "text", "lang"))
    trusted = spark.createDataFrame([(k,) for k in range(0, 200)] + [(None,)], "doc_id long")
    out = kneser_ney.classify(docs.filter("doc_id is null or doc_id >= 11 or doc_id in (3, 4)"), trusted)
    rows = out.collect()
    assert not any(r.kept for r in rows if (r.doc_id or 0) >= 1000)
    assert all(r.kept for r in rows if 11 <= (r.doc_id or 0) < 1000)
    assert kneser_ney.classify(odd_documents(spark), trusted).count() == odd_documents(spark).count()
    assert kneser_ney.classify(no_documents(spark), trusted).count() == 0
    assert all(r.kept for r in kneser_ney.classify(odd_documents(spark), trusted.filter("doc_id < 0")).collect())
