"""Words and draws of near-duplicate signatures: few steps for each, and what plain ones give."""

import random

import numpy as np
import pytest

from webloam.llm import near_dedup


def odd_texts():
    rng = random.Random(1)
    anywhere = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD800), rng.randrange(0x10000, 0x20000)])
    texts = ["", "a", "_", " \n", "İstanbul ΟΔΟΣ x", "\x00 b\x00c", "日本語 テキスト", "naïve ½ ²x ٣٤٥", "𝒳𝒴 🙂 a🙂b", "#" * 9000 + " w " + "?" * 9000]
    texts += [" ".join("x" * n for n in range(70)), " ".join("é" * n for n in range(40)), "y" * 5000]
    return texts + ["".join(chr(anywhere()) for _ in range(rng.randrange(300))) for _ in range(60)]


def test_words_are_hashed_together(monkeypatch):
    import xxhash

    plain, texts = xxhash.xxh64_intdigest, odd_texts()
    asked = []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: asked.append(w) or plain(w))
    hashes, sizes = near_dedup.word_hashes(texts, near_dedup.word_memo())
    words = [near_dedup.WORD.findall(t.lower()) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    assert hashes.tolist() == [plain(w) >> 1 for own in words for w in own]
    assert 0 < len(asked) == sum(len(w.encode()) > 31 for own in words for w in own)
    none = near_dedup.word_hashes(["", " "], near_dedup.word_memo())
    assert none[0].tolist() == [] and none[1].tolist() == [0, 0]


def plain_samples(sampler, starts, key, weight):
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(key)]):
        row = []
        for x, m in sampler.seeds:
            h = (key[lo:hi] ^ x) * m
            r, beta, log_c = (t[(h >> np.uint64(s)) & np.uint64(near_dedup.DRAWS - 1)] for t, s in ((sampler.r, 48), (sampler.beta, 32), (sampler.log_c, 16)))
            level = np.floor(np.log(weight[lo:hi]) / r + beta)
            best = np.argmin(log_c - r * (level - beta + 1))
            row.append(near_dedup.mixed(key[lo:hi][best:best + 1] + np.uint64(int(level[best]) + 4096) * np.uint64(0x9E3779B97F4A7C15))[0])
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("likely", [near_dedup.LIKELY, -3])
def test_a_draw_works_out_few_shingles(monkeypatch, likely):
    """Also where hardly any text has a value as small as expected, and all its shingles have to be worked out."""
    monkeypatch.setattr(near_dedup, "LIKELY", likely)
    monkeypatch.setattr(near_dedup, "CUT", 700)
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 700, 1400, 1, 2500, 30]
    key, weight = rng.integers(0, 1 << 64, sum(sizes), dtype=np.uint64), 1 + rng.random(sum(sizes)) * rng.integers(1, 40, sum(sizes))
    starts, sampler = np.cumsum([0, *sizes[:-1]]), near_dedup.Sampler()
    worked, least = [], sampler.least
    monkeypatch.setattr(sampler, "least", lambda h, *rest: worked.append(len(h)) or least(h, *rest))
    assert (sampler.samples(starts, key, weight) == plain_samples(sampler, starts, key, weight)).all()
    if likely > 0:
        assert sum(worked) < len(key) * near_dedup.BANDS * near_dedup.ROWS / 5
