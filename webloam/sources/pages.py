"""Readers of fetched pages and of PDF page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloam.schemas import PAGES, PDF_PAGES


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast; missing ones become typed NULLs."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    # Parquet files carry their own types, which are cast; JSON is read with the schema, never inferred.
    if fmt == "parquet":
        return conform(spark.read.parquet(path), schema)
    return spark.read.schema(schema).format(fmt).load(path)


# S1
def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, PAGES)


# S2
def read_pdf_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, PDF_PAGES)
