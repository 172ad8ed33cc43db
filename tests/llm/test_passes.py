"""Passes over documents whose partitions change between two jobs."""

import pytest
from pyspark.sql import functions as F

from webloam.llm import common, fertility, kneser_ney, near_dedup


def test_ids_are_left_out_also_when_splits_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = spark.range(400).select(F.when(F.col("id") != 13, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows.coalesce(1).write.option("maxRecordsPerFile", 100).parquet(path)
    docs = spark.read.parquet(path)
    kept = common.without(docs, spark.range(0, 400, 2).select(F.col("id").alias("doc_id")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id")))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # all files go to one task from now on
    try:
        assert kept.columns == docs.columns
        found = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(x for x in found if x is not None) == [x for x in range(1, 400, 2) if x != 13] and found.count(None) == 1


def test_a_pass_over_other_blocks_is_an_error(spark):
    rows = spark.range(40).select("id", F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    placed = common.block_of(rows.coalesce(1))
    marks = common.put_by_block(placed.select("block", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("fold")), 1, "marks")
    assert kneser_ney.counted(rows.coalesce(1), marks, 1).filter("n > 0").count() == 0
    with pytest.raises(Exception, match="two passes over the documents disagree"):
        kneser_ney.counted(rows.coalesce(2), marks, 1).count()


def test_few_rows_of_a_batch_are_tuples_at_once():
    import pyarrow as pa

    class Batch:
        """A batch that tells the most rows it was asked for."""
        def __init__(self, rows):
            self.rows, self.num_rows, self.most = rows, rows.num_rows, 0

        def slice(self, at, n):
            part = self.rows.slice(at, n)
            self.most = max(self.most, part.num_rows)
            return part

        @property
        def columns(self):
            self.most = self.num_rows
            return self.rows.columns

    batch = Batch(pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": [None, "t"] * 1000}))
    assert list(common.tuples(iter([batch]))) == [(k, [None, "t"][k % 2]) for k in range(2000)]
    assert batch.most <= common.TUPLES


def test_plans_of_the_model_do_not_hold_the_plans_of_all_levels(spark, monkeypatch, capsys):
    plans, settled = {}, kneser_ney.settled

    def seen(df, name):
        df.explain()
        plans[name] = capsys.readouterr().out
        return settled(df, name)

    monkeypatch.setattr(kneser_ney, "settled", seen)
    docs = spark.createDataFrame([(k, f"some text of number {k}", "en") for k in range(40)], "doc_id long, text string, lang string")
    assert kneser_ney.classify(docs, docs.filter("doc_id < 30")).count() == 40
    assert {f"order{k}" for k in range(1, 5)} < set(plans)
    assert max(p.count("HashAggregate") for p in plans.values()) <= 6
    assert max(p.count("Scan parquet") for p in plans.values()) <= 5  # the level, its discounts, both again for contexts, and the order below


def test_trusted_documents_stay_where_the_caller_asks(spark):
    rows = [(k, "plain words of a text that is like all others", "en") for k in range(200)] + [(k, "#$%&QXZ" * (k - 199), "en") for k in range(200, 204)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.filter("doc_id < 202")
    kept = lambda **more: {r.doc_id for r in kneser_ney.classify(docs, trusted, **more).filter("kept").collect()}
    assert not {200, 201} <= kept()
    assert {r.doc_id for r in trusted.collect()} <= kept(keep_trusted=True) and 203 not in kept(keep_trusted=True)


def test_a_block_asks_once_for_an_ngram(spark, monkeypatch):
    paths, put = {}, kneser_ney.put_by_block

    def seen(rows, shelves, name):
        paths[name] = put(rows, shelves, name)
        return paths[name]

    monkeypatch.setattr(kneser_ney, "put_by_block", seen)
    docs = spark.createDataFrame([(k, f"text {'ab' * (k % 5)} of a {'trusted' if k < 30 else 'plain'} kind", ["en", "0:x", None][k % 3]) for k in range(40)], "doc_id long, text string, lang string")
    rows = kneser_ney.perplexities(docs, docs.filter("doc_id < 30")).collect()
    assert len(rows) == 40 and all(r.perplexity > 0 for r in rows)
    answers = spark.read.parquet(paths["answers"])
    assert answers.count() == answers.select("block", "lang", "gram").distinct().count()
    assert {r.lang for r in answers.select("lang").distinct().collect()} == {"en", "0:x", ""}
    assert answers.filter("nats0 IS NULL").isEmpty() and not answers.filter("nats1 IS NULL").isEmpty()


def test_workers_hold_the_words_of_few_texts():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"w{(k * 300 + j) % 20_000}" for j in range(300)) for k in range(1000)]
    memo, idf = near_dedup.word_memo(), np.ones(near_dedup.BUCKETS)
    near_dedup.word_hashes(texts, memo)  # what is remembered between texts is not what is looked at

    def peak(work):
        work()  # what is loaded once
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 2**20

    def signed():
        for part in near_dedup.parts(iter([pa.RecordBatch.from_pydict({"text": texts})])):
            near_dedup.shingles(part.column(0).to_pylist(), memo, idf)

    def ruled():
        for at in range(0, len(texts), fertility.BATCH):
            [fertility.base_counts(t) for t in texts[at:at + fertility.BATCH]]

    assert peak(signed) < 20 and peak(ruled) < 10
