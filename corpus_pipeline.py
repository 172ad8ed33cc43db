"""Documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before kept, and all but the last give documents with the same columns. A stage
decides by document id: rows of one id are one document, and go or stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloam.llm import decontaminate, fertility, kneser_ney, near_dedup, packing
from webloam.llm.common import settled, without


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text of their language is no worse than its threshold, and all trusted ones.

    The threshold is a quantile of trusted texts, so some of them lie above it however good they are; their labels say more than the model.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0")
    return without(docs, kneser_ney.classify(docs, trusted, keep_trusted=True).filter("NOT kept"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return without(docs, fertility.quality_rules(docs, fence=fertility.FENCES).filter("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of the least id, once. Documents without an id stay.

    Of rows of one id that is kept, whatever their texts, any one stays.
    """
    classes = settled(near_dedup.near_classes(docs.filter("doc_id IS NOT NULL")), "classes")
    again = classes.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone = classes.filter("doc_id <> class_id").select("doc_id")
    if again.isEmpty():
        return without(docs, gone)
    repeated = docs.join(again.select(F.col("doc_id").alias("_again")), F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return without(docs, gone.unionByName(again)).unionByName(repeated)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where it lies in which sequence."""
    return packing.pack(packing.token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, "stage")
    return docs


#: SQL can express neither the models nor the tokens that the stages work with.
ORACLE_SQL = None
