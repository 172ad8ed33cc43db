"""Audit use cases over documents and logs: density, structure, thin pages, changes, new URLs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloam.functions.html import swept
from webloam.functions.text import collapse_ws, extract_text_content, let, search_tokens


# U1
def keyword_density(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, count, share): share of each term among the terms of its document.

    A document is one row, so its terms are sorted and counted inside it, run by run; nothing is exchanged. The outer form of
    explode keeps the optimizer from testing the array in a filter of its own, which would make the terms twice.
    """
    def counted(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)))
        return F.when(F.size(words) > 0, let(starts, lambda ss: F.transform(ss, lambda s, k: F.struct(
            F.get(words, s - 1).alias("term"), (F.coalesce(F.get(ss, k + 1), F.size(words) + 1) - s).cast("long").alias("count"),
            F.size(words).alias("total")))))

    words = F.array_sort(search_tokens(extract_text_content(F.col("markdown"))))
    return (
        docs.select(key, F.explode_outer(let(words, counted)).alias("t"))
        .filter(F.col("t").isNotNull())
        .select(key, "t.term", "t.count", (F.col("t.count") / F.col("t.total")).alias("share"))
    )


# U2
def heading_structure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, level, heading, parent): headings in order with the ordinal of their parent.

    The parent is the last earlier heading of a lower level. One fold inside the row remembers the last ordinal of each level, so
    nothing is exchanged and no document is sorted.
    """
    lines = F.filter(F.split(F.col("markdown"), "\n"), lambda x: x.rlike(r"^#{1,6}[ \t]+[^ \t]"))
    heads = F.transform(lines, lambda x, i: F.struct(
        i.alias("ordinal"), F.length(F.regexp_extract(x, "^(#{1,6})", 1)).alias("level"),
        collapse_ws(F.regexp_extract(x, r"(?s)^#{1,6}[ \t]+(.*)$", 1)).alias("heading")))

    def step(last: Column, h: Column) -> Column:
        above = F.array_max(F.filter(last, lambda o, n: (n < h["level"] - 1) & (o >= 0)))
        return F.struct(F.transform(last, lambda o, n: F.when(n == h["level"] - 1, h["ordinal"]).otherwise(o)).alias("state"),
                        F.array(above).alias("out"))

    def placed(hs: Column) -> Column:
        return let(swept(hs, F.array_repeat(F.lit(-1), 6), "array<int>", step), lambda parents: F.transform(hs, lambda h, i: F.struct(
            h["ordinal"].alias("ordinal"), h["level"].alias("level"), h["heading"].alias("heading"), F.get(parents, i).alias("parent"))))

    return docs.select(key, F.explode_outer(let(heads, placed)).alias("h")).filter(F.col("h").isNotNull()).select(key, "h.*")


def word_count(markdown: Column) -> Column:
    return let(extract_text_content(markdown), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))))


# U3
def thin_content(docs: DataFrame, min_words: int, key: str = "doc_id") -> DataFrame:
    """(key, words) of the documents below ``min_words`` words."""
    return docs.select(key, word_count(F.col("markdown")).alias("words")).filter(F.col("words") < min_words)


# U4
def content_changes(logs: DataFrame, unit: str = "hour") -> DataFrame:
    """(url, timestamp, id, previous_hash, content_hash) where the content of a URL changed.

    Logs are read once. The fetches of a URL within an hour (or another ``unit`` of time) are one group, which keeps its first fetch, its
    last hash and, in order, the changes between; the hours of a URL are then linked by these short rows, so a URL with very
    many fetches is as many groups as it has hours. Equal times go by id.
    """
    rows = logs.filter(F.col("content_hash").isNotNull()).select("url", "timestamp", "id", "content_hash", F.date_trunc(unit, "timestamp").alias("hour"))
    fetches = F.array_sort(F.collect_list(F.struct("timestamp", "id", "content_hash")))

    def change(x: Column, before: Column) -> Column:
        return F.struct(x["timestamp"].alias("timestamp"), x["id"].alias("id"), before.alias("previous_hash"), x["content_hash"].alias("content_hash"))

    def folded(xs: Column) -> Column:
        every = F.transform(xs, lambda x, i: change(x, F.get(xs, i - 1)["content_hash"]))
        return F.struct(F.get(xs, F.lit(0)).alias("first"), F.element_at(xs, -1)["content_hash"].alias("last_hash"),
                        F.filter(every, lambda c: c["previous_hash"] != c["content_hash"]).alias("changes"))

    hours = rows.groupBy("url", "hour").agg(fetches.alias("_f")).select("url", "hour", let(F.col("_f"), folded).alias("_h"))
    linked = hours.withColumn("_before", F.lag("_h.last_hash").over(Window.partitionBy("url").orderBy("hour")))
    turn = F.filter(F.array(change(F.col("_h.first"), F.col("_before"))), lambda c: c["previous_hash"] != c["content_hash"])
    return linked.select("url", F.explode_outer(F.concat(turn, F.col("_h.changes"))).alias("c")).filter(F.col("c").isNotNull()).select("url", "c.*")


# U5
def new_urls(logs: DataFrame, since: datetime) -> DataFrame:
    """(url, first_seen) of the URLs first fetched at or after ``since``."""
    return logs.groupBy("url").agg(F.min("timestamp").alias("first_seen")).filter(F.col("first_seen") >= F.lit(since))
