"""Full-text search over url and markdown: ad hoc by pattern, repeated by postings.

Tokens are runs of letters and digits, case-folded, with diacritics removed. The query
surface is structured arguments; terms and filters compose.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions.text import NON_TOKEN_CLASS, fold, fold_term, let, search_tokens
from webloam.operators.audit import filter_logs
from webloam.schemas import LogFilters, like_anywhere

FIELDS = {"url": "url", "markdown": "markdown_content"}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold_term(text))


@dataclass(frozen=True)
class Terms:
    """All of these, at least one of those, none of those, a phrase, a prefix; one field or both."""

    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    phrase: str | None = None
    prefix: str | None = None
    field: str | None = None

    def columns(self) -> list[str]:
        return [FIELDS[self.field]] if self.field else list(FIELDS.values())


def _holds(folded: Column, words: list[str], prefix: bool = False) -> Column:
    """The words stand next to each other in the folded text. A plain search decides first."""
    if not words:
        return F.lit(False)
    longest = max(words, key=len)
    end = "" if prefix else rf"(?:{NON_TOKEN_CLASS}|\z)"
    pattern = rf"(?:\A|{NON_TOKEN_CLASS})" + f"{NON_TOKEN_CLASS}+".join(words) + end
    return F.contains(folded, F.lit(longest)) & folded.rlike(pattern)


def match(terms: Terms) -> Column:
    """Predicate over a log row. A term of several words counts as a phrase."""
    def test(texts: Column) -> Column:
        def somewhere(words: list[str], prefix: bool = False) -> Column:
            hits = [_holds(texts[f"c{i}"], words, prefix) for i in range(len(terms.columns()))]
            return reduce(lambda a, b: a | b, hits)

        parts = [somewhere(words_of(t)) for t in terms.all_of]
        if terms.any_of:
            parts.append(reduce(lambda a, b: a | b, [somewhere(words_of(t)) for t in terms.any_of]))
        parts += [~somewhere(words_of(t)) for t in terms.none_of]
        if terms.phrase:
            parts.append(somewhere(words_of(terms.phrase)))
        if terms.prefix:
            parts.append(somewhere(words_of(terms.prefix), prefix=True))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    texts = F.struct(*[
        F.coalesce(fold(F.col(c)), F.lit("")).alias(f"c{i}") for i, c in enumerate(terms.columns())])
    return let(texts, test)


# J1
def search_logs(logs: DataFrame, terms: Terms, filters: LogFilters | None = None) -> DataFrame:
    """Matching log rows; order and page them with the audit operators (newest first)."""
    return filter_logs(logs, filters).filter(match(terms))


# J2
def search_logs_like(logs: DataFrame, query: str, filters: LogFilters | None = None) -> DataFrame:
    """Substring search in url or markdown, ``%`` and ``_`` being wildcards."""
    return filter_logs(logs, filters).filter(
        like_anywhere(F.col("url"), query) | like_anywhere(F.col("markdown_content"), query))


# J3
def build_postings(logs: DataFrame) -> DataFrame:
    """(field, term, id, positions[, log_date]): inverted index over url and markdown.

    All positions of a term in a log come out of one row: its words are sorted with their places and cut where the word
    changes, so finished postings leave the row and nothing is exchanged.
    """
    day = ["log_date"] if "log_date" in logs.columns else []
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("text")) for name, c in FIELDS.items()])

    def postings(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 1)["w"] != F.get(words, i - 2)["w"]))
        return F.when(F.size(words) > 0, let(starts, lambda ss: F.transform(ss, lambda s, k: F.struct(
            F.get(words, s - 1)["w"].alias("term"),
            F.transform(F.slice(words, s, F.coalesce(F.get(ss, k + 1), F.size(words) + 1) - s), lambda x: x["i"]).alias("positions")))))

    # sort_array compares structs by itself, array_sort by an expression that is interpreted for every comparison
    placed = lambda text: F.sort_array(F.transform(search_tokens(text), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return (
        logs.select("id", *day, F.explode(fields).alias("f"))
        .select("id", *day, F.col("f.field").alias("field"), F.explode_outer(let(placed(F.col("f.text")), postings)).alias("p"))
        .filter(F.col("p").isNotNull())
        .select("field", "p.term", "id", *day, "p.positions")
    )


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda p: p - back)


def search_postings(postings: DataFrame, terms: Terms) -> DataFrame:
    """Ids of matching logs, from the postings alone (``all_of``, ``any_of``, ``phrase``, ``prefix``).

    Only postings of the wanted terms are read. The grouping by id and field sees one row per wanted word, or per word of the
    log that begins with the prefix, so no group grows with the number of logs. A term without a word matches nothing, as
    in ``search_logs``; no terms at all are for ``search_with_postings``, since logs without words have no postings.
    """
    if terms.none_of:
        raise ValueError("none_of needs the log rows: use search_logs")
    asked = [words_of(t) for t in terms.all_of] + ([words_of(terms.phrase)] if terms.phrase else [])
    either = [words_of(t) for t in terms.any_of]
    names = sorted({w for ws in asked + either for w in ws})
    wanted = F.col("term").isin(*names) if names else F.lit(False)
    start = words_of(terms.prefix) if terms.prefix else []
    names = sorted({*names, *start[:-1]})
    wanted = F.col("term").isin(*names) if names else F.lit(False)
    if start:
        wanted = wanted | F.col("term").startswith(start[-1])
    rows = postings.filter(wanted)
    if terms.field:
        rows = rows.filter(F.col("field") == terms.field)
    slot = {w: f"p{i}" for i, w in enumerate(names)}
    per_field = rows.groupBy("id", "field").agg(
        F.max(F.lit(1)).alias("_any"),
        *[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(c) for w, c in slot.items()],
        *([F.flatten(F.collect_list(F.when(F.col("term").startswith(start[-1]), F.col("positions")))).alias("pre")] if start else []))

    def adjoining(places: list[Column]) -> Column:
        """Some place of the first is followed by places of the others, in order: each moved back by its number, they meet."""
        return F.size(reduce(F.array_intersect, [_moved(c, k) for k, c in enumerate(places)])) > 0

    def phrase(ws: list[str]) -> Column:
        return adjoining([F.col(slot[w]) for w in ws]) if ws else F.lit(False)

    tests = [phrase(ws) for ws in asked]
    if terms.any_of:
        tests.append(reduce(lambda a, b: a | b, [phrase(ws) for ws in either]))
    if terms.prefix:
        tests.append(adjoining([*[F.col(slot[w]) for w in start[:-1]], F.col("pre")]) if start else F.lit(False))
    if not tests:
        raise ValueError("no terms: every log matches")
    flags = per_field.select("id", *[F.coalesce(t, F.lit(False)).alias(f"t{i}") for i, t in enumerate(tests)])
    whole = flags.groupBy("id").agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(tests))])
    return whole.filter(reduce(lambda a, b: a & b, [F.col(f"t{i}") for i in range(len(tests))])).select("id")


def search_with_postings(logs: DataFrame, postings: DataFrame, terms: Terms,
                         filters: LogFilters | None = None) -> DataFrame:
    """J1 through the postings: semi-join of the filtered logs with the matching ids. Without terms, all filtered logs."""
    if terms == Terms(field=terms.field):
        return filter_logs(logs, filters)
    return filter_logs(logs, filters).join(search_postings(postings, terms), "id", "left_semi")


# J4
def maintain_postings(logs_path: str, postings_path: str):
    """A ``foreachBatch`` function that keeps the postings equal to the log table.

    The days touched by a batch (column ``log_date``; a handful of values) are rebuilt
    from the log table and replaced as whole partitions, so running a batch again changes
    nothing. A day without logs loses its postings.
    """
    from webloam.sources.logs import drop_day, read_log_files

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = [r["log_date"] for r in batch.select("log_date").distinct().collect()]
        if not days:
            return
        logs = read_log_files(spark, logs_path).filter(F.col("log_date").isin(*days))
        live = {r["log_date"] for r in logs.select("log_date").distinct().collect()}
        for day in days:
            if day not in live:
                drop_day(spark, postings_path, day)
        # by range, so that a term lies in few files, which the search finds by their bounds
        order = ("log_date", "field", "term")
        (build_postings(logs).repartitionByRange(*order).sortWithinPartitions(*order)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("log_date").parquet(postings_path))

    return run
