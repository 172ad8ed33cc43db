"""From fetched pages to documents: the whole page chain with its switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions import html as H
from webloam.functions.reuse import per_application
from webloam.functions.text import inject_section, inject_title
from webloam.operators import content as C
from webloam.operators.pages import link_counts, pruned_tokens
from webloam.operators.scientific import scientific_preprocess
from webloam.schemas import PipelineConfig


# The large expressions of the chain, over fixed column names.
@per_application
def _texts(config: PipelineConfig) -> Column:
    nothing = F.array().cast("array<string>")
    kept = pruned_tokens(F.col("_tokens")) if config.prune else F.col("_tokens")
    whole = F.when(F.col("_classic") & F.col("fallback_markdown").isNull(), F.col("_whole")).otherwise(nothing)
    return H.both_markdowns(kept if config.extract else nothing, whole, config.min_words)


@per_application
def _titles() -> Column:
    return F.struct(H.page_title(F.col("_whole")).alias("page"), H.og_title(F.col("_whole")).alias("og"))


@per_application
def _titled() -> Column:
    return inject_title(F.coalesce("html_answer", F.col("_pick.markdown")), F.coalesce("page_title", "_titles.page"),
                        F.coalesce("og_title", "_titles.og"), F.col("url"))


@per_application
def _finished(config: PipelineConfig) -> Column:
    markdown = C.cleaned(F.col("_doc"), config) if config.regex_clean else F.col("_doc")
    return C.strip_interface_residue(markdown) if config.strip_residue else markdown


@per_application
def _links() -> Column:
    return link_counts(F.col("_whole"), F.col("url"))


# D13
def process_pages(pages: DataFrame, config: PipelineConfig = PipelineConfig(),
                  responses: DataFrame | None = None, keep: tuple[str, ...] = (), counts: bool = False) -> DataFrame:
    """(page_id, url, markdown, title, steps_applied): one document per page.

    Without a responses table the chain is one map-only stage. With one, the answers are
    joined by page_id and only unanswered pages go through the classic steps. ``keep``
    names further page columns to carry along. ``counts`` adds ``_counts``, links and images of
    the page as it was fetched, out of the same tokens.
    """
    df = pages
    for name in ("fallback_markdown", "page_title", "og_title"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumn("_raw", F.col("html"))
    if responses is not None:
        df = C.apply_html_extractions(df, responses, config)
        classic = F.col("html_answer").isNull()
        # Answered pages enter no classic step: their html is emptied before the tokens are made.
        df = df.withColumn("html", F.when(classic, F.col("html")).otherwise(F.lit("")))
    else:
        df = df.withColumn("html_answer", F.lit(None).cast("string"))
        classic = F.lit(True)

    df = scientific_preprocess(df, config.min_section_chars)
    scientific = F.col("is_scientific") & classic
    raw_tokens = H.text_tokens(F.col("_raw"))
    df = df.withColumn("_tokens", H.text_tokens(F.col("html")))
    # The whole-page fallback and the titles see the page as it was fetched.
    df = df.withColumn("_whole", F.when(scientific, raw_tokens).otherwise(F.col("_tokens")))
    if responses is not None:
        df = df.withColumn("_whole", F.when(classic, F.col("_whole")).otherwise(raw_tokens))
    df = df.withColumn("_classic", classic)
    df = df.select(
        "page_id", "url", "html_answer", "scientific_content", "is_scientific", "fallback_markdown", *keep,
        _texts(config).alias("_texts"), _titles().alias("_titles"), "page_title", "og_title",
        *([_links().alias("_counts")] if counts else []))
    keep = (*keep, "_counts") if counts else keep
    df = df.withColumn("_main", F.col("_texts")[0]).withColumn(
        "_fallback", F.coalesce("fallback_markdown", F.col("_texts")[1]))
    df = df.withColumn("_pick", C.choose_extraction(F.col("_main"), F.col("_fallback"), config))
    df = df.withColumn("_titled", _titled())
    has_science = classic & (F.length("scientific_content") > 0)
    df = df.withColumn("_doc", F.when(has_science, inject_section(
        F.col("_titled.markdown"), F.col("scientific_content"))).otherwise(F.col("_titled.markdown")))
    steps = F.array_compact(F.array(
        F.when(~classic, F.lit("llm_html_sanitize")),
        F.when(scientific, F.lit("scientific_preprocess")),
        F.when(classic, F.lit("dom_pruning")) if config.prune else F.lit(None).cast("string"),
        F.when(classic, F.col("_pick.step")),
        F.lit("title_injection"),
        F.when(has_science, F.lit("scientific_inject")),
        F.lit("regex_cleaning") if config.regex_clean else F.lit(None).cast("string"),
    ))
    docs = df.select("page_id", "url", _finished(config).alias("markdown"), F.col("_titled.title").alias("title"),
                     steps.alias("steps_applied"), *keep)
    if responses is not None:
        docs = C.apply_structure_fixes(docs, responses, config)
    return docs
