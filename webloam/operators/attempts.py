"""Folding fetch attempts into one final result per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions.outcome import is_browser_crash, is_retryable
from webloam.functions.text import let
from webloam.schemas import MAX_ATTEMPTS


# W2
def resolve_attempts(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, run_key: tuple[str, ...] = ()) -> DataFrame:
    """(url, success, error, attempts, retry_count) from (url, attempt, success, error, kind, restarted).

    ``run_key`` names the columns that tell several runs of one URL apart; they stand before the result's others.

    The first success or final error ends the run; later attempts and attempts beyond the
    limit count for nothing. Only ``max_attempts`` slots per URL are aggregated, each with a
    map-side maximum, so a URL with very many rows is no hot group. A run whose log ends
    early keeps its last error.
    """
    error, kind = F.col("error"), F.coalesce(F.col("kind"), F.lit("html"))
    failed = ~F.coalesce(F.col("success"), F.lit(False)) & (F.length(error) > 0)
    crashed = failed & (kind != "pdf") & is_browser_crash(error)
    again = F.coalesce(F.when(crashed, F.col("restarted")).otherwise(failed & is_retryable(error, kind)), F.lit(False))
    lost = F.coalesce(crashed & ~F.coalesce(F.col("restarted"), F.lit(False)), F.lit(False))
    slot = F.struct(F.col("attempt").alias("attempt"), F.coalesce(F.col("success"), F.lit(False)).alias("success"),
                    error.alias("error"), again.alias("again"), lost.alias("lost"))
    slots = attempts.filter(F.col("attempt").between(1, max_attempts)).groupBy(*run_key, "url").agg(
        *[F.max(F.when(F.col("attempt") == k, slot)).alias(f"a{k}") for k in range(1, max_attempts + 1)])

    def resolve(run: Column) -> Column:
        stop = F.get(F.filter(run, lambda a: ~a["again"]), F.lit(0))
        last = F.element_at(run, -1)

        def final(end: Column) -> Column:
            before = F.size(F.filter(run, lambda a: a["again"] & (a["attempt"] < end["attempt"])))
            return F.when(end.isNotNull(), F.struct(
                end["success"].alias("success"), F.when(~end["success"], end["error"]).alias("error"),
                end["attempt"].cast("int").alias("attempts"),
                F.when(end["lost"], F.lit(0)).otherwise(before).alias("retry_count"))).otherwise(F.struct(
                    F.lit(False).alias("success"),
                    F.when(F.size(run) == max_attempts, F.concat(
                        F.lit(f"Failed after {max_attempts} attempts: "), last["error"])).otherwise(last["error"]).alias("error"),
                    last["attempt"].cast("int").alias("attempts"), F.size(run).alias("retry_count")))

        return let(stop, final)

    run = F.array_compact(F.array(*[F.col(f"a{k}") for k in range(1, max_attempts + 1)]))
    return slots.select(*run_key, "url", let(run, resolve).alias("r")).select(*run_key, "url", "r.*")
