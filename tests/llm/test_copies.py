"""Benchmark passages, near-duplicate classes, components, and the pipeline over small tables."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, no_documents, odd_documents
from webloam.llm import common, components, decontaminate, near_dedup


def edits_to_any_stretch(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(words, n, rng, vocabulary):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 1:
            del words[at]
    return words


def test_verification_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item, text = [[rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        assert decontaminate.edit_distance_within(item, text)[0] == edits_to_any_stretch(item, text)
    item, text = [1, 2] * 60, [3] * 50 + [1, 2] * 60 + [3] * 9  # beyond a machine word
    assert decontaminate.edit_distance_within(item, text) == (0, 170)


def test_the_gate_loses_no_stretch_within_reach():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50)))) for k in range(60)]
    index = decontaminate.ItemIndex(items, 0.2, 0.999)
    for k, (_, ids) in enumerate(index.items):
        words = decontaminate.words_of(items[k][1])
        other = edited(words, decontaminate.allowed(len(words), 0.2), rng, vocabulary)
        text = [rng.choice(vocabulary) for _ in range(30)] + other + [rng.choice(vocabulary) for _ in range(30)]
        row = np.array([0] * index.pad + [index.vocab.get(w, 0) for w in text] + [0] * (2 * index.pad), np.int64)
        starts = dict(index.gate(row))
        assert any(abs(s - index.pad - 30) <= len(words) for s in starts.get(len(words), [])), (k, len(words))


def test_recall_at_the_allowed_distance_and_no_false_pairs():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 50)))) for k in range(50)]
    index = decontaminate.ItemIndex(items, 0.2, 0.999)
    texts, planted = [], set()
    for t in range(400):
        k = rng.randrange(50)
        words = decontaminate.words_of(items[k][1])
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 100))] + edited(words, decontaminate.allowed(len(words), 0.2), rng, vocabulary)
                     + [rng.choice(vocabulary) for _ in range(rng.randint(0, 100))])
        planted.add((t, k))
    found = {(t, k): e for t, k, e, _ in index.find(texts)}
    assert len(planted & set(found)) >= 0.97 * len(planted)
    for (t, k), e in found.items():
        own = decontaminate.words_of(items[k][1])
        assert e == edits_to_any_stretch(own, texts[t]) <= decontaminate.allowed(len(own), 0.2)


def test_contaminated_documents(spark):
    items = spark.createDataFrame([(1, PROSE), (2, "boil a strange green soup in the old kitchen"), (3, None), (4, "..."), (5, "soup"), (6, PROSE)], "item_id int, text string")
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(50, "well " + PROSE.upper() + "!", "en", "a", 1, 9, "", "", "", "")], odd_documents(spark).schema))
    found = decontaminate.contaminated(docs, items)
    pairs = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.edits) for r in found.collect())
    prose = [(1, 0), (2, 0), (5, 0), (6, 0)]
    want = sorted([(d, i, e) for d in (1, 2, 2, 50, -1) for i, e in prose] + [(8, 1, 1), (8, 2, 0), (8, 5, 0), (8, 6, 1)])
    assert pairs == want
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items, block_items=2).collect()) == want
    assert decontaminate.contaminated(no_documents(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.filter("item_id > 90")).count() == 0


def closure(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    found = components.components(spark.createDataFrame([*links, (None, 5), (7, 7)], "u long, v long"))
    assert {r.node: r.root for r in found.collect()} == closure([x for x in links if x[0] != x[1]])
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_classes(rows, idf):
    texts = [t or "" for _, t in rows]
    text, key, weight = near_dedup.shingles(texts, near_dedup.word_memo(), idf)
    own = [(key[text == k], weight[text == k]) for k in range(len(rows))]
    links = []
    for (a, x), (b, y) in combinations(enumerate(own), 2):
        if texts[a] == texts[b] or len(x[0]) and len(y[0]) and near_dedup.similarity(*x, *y) >= near_dedup.SIMILARITY:
            links.append((rows[a][0], rows[b][0]))
    joined = closure(links)
    return {i: joined.get(i, i) for i, _ in rows}


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for copy in range(rng.randint(1, 6)):
            words = edited(base, rng.randint(0, max(1, len(base) // 45)), rng, vocabulary) if copy else base
            rows.append((n, " ".join(words)))
            n += 1
    # a group without a centre: each is near the next one only
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(30):
        at = rng.randrange(190)
        chain = chain[:at] + [rng.choice(vocabulary) for _ in range(6)] + chain[at + 6:]
        rows.append((n, " ".join(chain)))
        n += 1
    return rows


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(docs.select("text")).astype(float)
    want = brute_classes(rows, idf)
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == want
    # without star rounds' help, in small blocks
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs, rounds=1).collect()} == want


def test_classes_of_odd_documents(spark):
    found = {r.doc_id: (r.copy_of, r.class_id) for r in near_dedup.near_classes(odd_documents(spark)).collect()}
    assert found[1] == found[2] == (1, 1) and found[3] == found[4] == (3, 3) and found[9] == (9, 9)
    assert near_dedup.near_classes(odd_documents(spark)).count() == odd_documents(spark).count()
    assert near_dedup.near_classes(no_documents(spark)).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    other = edited(base, 12, rng, vocabulary)
    idf = np.linspace(1, 2, near_dedup.BUCKETS)
    text, key, weight = near_dedup.shingles([" ".join(base), " ".join(other)], near_dedup.word_memo(), idf)
    starts = np.searchsorted(text, [0, 1])
    s = near_dedup.Sampler(draws=2000).samples(starts, key, weight)
    truth = near_dedup.similarity(key[text == 0], weight[text == 0], key[text == 1], weight[text == 1])
    assert abs((s[0] == s[1]).mean() - truth) < 0.04


def test_running_totals(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 50), k, rng.choice([None, 1, 5])) for k in range(500)]
    found = common.with_running(spark.createDataFrame(rows, "a int, b int, n long"), ["a", "b"], ["n"], "t").collect()
    want, total = {}, 0
    for k, (a, b, n) in enumerate(sorted(rows, key=lambda r: r[:2])):
        want[b] = (k, total)
        total += n or 0
    assert {r.b: (r.position, r.n_before) for r in found} == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = PROSE.split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = {k: text(rng.randint(40, 90)) for k in range(200)}
    passage = "a passage of the benchmark that nobody should ever have put into the training data of this model"
    extra = {300: "".join(rng.choice("#$%&QXZ") for _ in range(400)), 301: "too short", 302: clean[7], 303: clean[8] + " again", 304: text(30) + " " + passage + " " + text(30)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in (clean | extra).items()] + [(9, clean[9], "en", "s", 1), (None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} - {None} == set(clean)
    assert sum(r.doc_id == 9 for r in packed) == 1
    assert {r.piece for r in packed} == {0} and all(r.sequence_id is not None for r in packed)
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        out = common.settled(out, "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_outlier_beside_a_solved_group_costs_a_task_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    rows = [(1, n, 0) for n in range(5000)] + [(1, 9000, 9000), (2, 9000, 9000), (2, 9001, 9001)]
    members = spark.createDataFrame(rows, "key long, node long, root long")
    own = near_dedup.blocks_of(members).collect()
    sizes = {}
    for r in own:
        sizes.setdefault((r.key, r.blk), set()).add(r.root)
    assert len(own) == len(rows) and len([k for k in sizes if k[0] == 1]) <= 51
    assert all(len(roots) == 1 for (key, blk), roots in sizes.items() if key == 1)
    keys = [1, 2, 3, 4, 5]
    near = [list(range(5)), list(range(1, 6))]
    vecs = spark.createDataFrame([(n, keys if n in (7, 9000) else [n * 9 + k + 100 for k in near[n % 2]], [1.0] * 5) for _, n, _ in rows if n != 9001]
                                 + [(9001, keys, [1.0] * 5)], "node long, keys array<int>, weights array<float>").dropDuplicates(["node"])
    links = {tuple(sorted((r.u, r.v))) for r in near_dedup.blockwise(members, vecs).collect()}
    assert links == {(7, 9000), (9000, 9001)}


def test_items_of_very_many_distinct_words(monkeypatch):
    monkeypatch.setattr(decontaminate.ItemIndex, "embed", lambda self, windows: np.zeros((len(windows), self.tables), np.int64))
    items = [(k, " ".join(f"w{150 * k + j}" for j in range(150))) for k in range(15_000)]
    index = decontaminate.ItemIndex(items, 0.2, 0.999)
    assert len(index.vocab) == 2_250_000
    for k in (0, 7_000, 14_999):
        words = decontaminate.words_of(items[k][1])
        row = np.array([0] * index.pad + [index.vocab.get(w, 0) for w in ["x"] * 20 + words + ["y"] * 20] + [0] * (2 * index.pad), np.int64)
        starts = dict(index.gate(row))
        assert any(abs(s - index.pad - 20) <= 30 for s in starts.get(150, []))
        strange = np.array([0] * index.pad + index.items[k][1][::-1] + [0] * (2 * index.pad), np.int64)
        assert not any(len(s) for s in dict(index.gate(strange)).values())
