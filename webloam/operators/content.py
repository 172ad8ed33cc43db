"""Document operators: choice of the extraction, prompts, answers, structure fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions.text import (
    extract_text_content, let, normalize_markdown_spacing, regex_clean, strip, strip_code_fence, truncate_chars,
)
from webloam.schemas import PipelineConfig

# Names of the four ways a document came about.
STEP_MAIN, STEP_SHORT, STEP_EMPTY, STEP_OFF = "main_content", "fallback_short", "fallback_empty", "fallback"


# D11
def choose_extraction(extracted: Column, fallback: Column, config: PipelineConfig = PipelineConfig()) -> Column:
    """struct(markdown, step): the extraction unless it is empty or below the share of the fallback."""
    other = F.coalesce(fallback, F.lit(""))
    if not config.extract:
        return F.struct(other.alias("markdown"), F.lit(STEP_OFF).alias("step"))

    def pick(p: Column) -> Column:
        floor = F.floor(F.length(p["o"]) * F.lit(config.min_ratio))
        return (
            F.when(F.coalesce(F.length(p["x"]), F.lit(0)) == 0,
                   F.struct(p["o"].alias("markdown"), F.lit(STEP_EMPTY).alias("step")))
            .when((F.length(p["x"]) >= floor) | (p["o"] == ""),
                  F.struct(p["x"].alias("markdown"), F.lit(STEP_MAIN).alias("step")))
            .otherwise(F.struct(p["o"].alias("markdown"), F.lit(STEP_SHORT).alias("step"))))

    return let(F.struct(extracted.alias("x"), other.alias("o")), pick)


# L1
def build_prompts(docs: DataFrame, template: str, content_col: str,
                  marker: str = "{{ content }}", max_chars: int | None = None) -> DataFrame:
    """``prompt``: the template around the content, which is inserted literally.

    Runs of blank lines are shortened in the template only.
    """
    before, _, after = template.partition(marker)
    content = F.col(content_col)
    if max_chars is not None:
        content = truncate_chars(content, max_chars)

    def short(text: str) -> str:
        while "\n\n\n" in text:
            text = text.replace("\n\n\n", "\n\n")
        return text

    return docs.withColumn("prompt", F.concat(
        F.lit(short(before).lstrip()), F.coalesce(content, F.lit("")), F.lit(short(after).rstrip())))


def clean_answer(response: Column) -> Column:
    return normalize_markdown_spacing(strip_code_fence(response))


def accepted_html_answer(response: Column, config: PipelineConfig = PipelineConfig()) -> Column:
    """The cleaned answer when it is long enough, else NULL."""
    return let(clean_answer(response), lambda x: F.when(F.length(x) >= config.min_answer_chars, x))


def accepted_structure_answer(original: Column, response: Column,
                              config: PipelineConfig = PipelineConfig()) -> Column:
    """The cleaned answer unless it loses more text than allowed, else NULL."""
    def judge(p: Column) -> Column:
        before, after = F.length(p["before"]), F.length(p["after"])
        loss = (F.lit(1.0) - after / before) * 100
        return F.when((before == 0) | (loss <= config.max_loss), p["x"])

    def measure(x: Column) -> Column:
        return let(F.struct(x.alias("x"), extract_text_content(original).alias("before"),
                            extract_text_content(x).alias("after")), judge)

    return F.when(F.length(response) > 0, let(clean_answer(response), measure))


def answers_of(responses: DataFrame, stage: str) -> DataFrame:
    """One answer per page for a stage. Several answers of one page: the greatest text is taken."""
    return (
        responses.filter(F.col("stage") == stage)
        .groupBy("page_id").agg(F.max("response").alias(f"{stage}_response"))
    )


# L2
def apply_html_extractions(pages: DataFrame, responses: DataFrame,
                           config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """``html_answer``: the accepted answer of each page, NULL where the classic chain has to run."""
    return (
        pages.join(answers_of(responses, "html"), "page_id", "left")
        .withColumn("html_answer", accepted_html_answer(F.col("html_response"), config))
        .drop("html_response")
    )


# L3
def apply_structure_fixes(docs: DataFrame, responses: DataFrame,
                          config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Replace ``markdown`` by the accepted structure answer; documents out of L2 are left alone."""
    joined = docs.join(answers_of(responses, "structure"), "page_id", "left")
    eligible = ~F.array_contains(F.col("steps_applied"), "llm_html_sanitize")
    return (
        joined.withColumn("_fix", F.when(eligible, accepted_structure_answer(
            F.col("markdown"), F.col("structure_response"), config)))
        .withColumn("markdown", F.coalesce("_fix", "markdown"))
        .withColumn("steps_applied", F.when(
            F.col("_fix").isNotNull(), F.array_append(F.col("steps_applied"), F.lit("llm_structure_sanitizer")))
            .otherwise(F.col("steps_applied")))
        .drop("_fix", "structure_response")
    )


# L4
def normalize_headings(markdown: Column) -> Column:
    """One H1 (the first), later ones become H2, no level is skipped, no text is lost.

    A heading goes at most one level deeper than the heading before it; the first one is
    an H1 or an H2.
    """
    level_re, text_re = r"^(#{1,6})[ \t]+[^ \t]", r"(?s)^#{1,6}[ \t]+(.*)$"

    def line(x: Column) -> Column:
        return F.struct(F.length(F.regexp_extract(x, level_re, 1)).alias("level"), x.alias("text"))

    # State per heading: the level given to the last one, whether an H1 was seen, the levels so far.
    start = F.struct(F.lit(0).alias("last"), F.lit(False).alias("h1"),
                     F.array().cast("array<int>").alias("part"), F.array().cast("array<array<int>>").alias("full"))

    def step(acc: Column, level: Column) -> Column:
        wanted = F.when((level == 1) & acc["h1"], F.lit(2)).otherwise(level)

        def put(new: Column) -> Column:
            big = F.size(acc["part"]) >= 256
            return F.struct(
                new.cast("int").alias("last"), (acc["h1"] | (new == 1)).alias("h1"),
                F.when(big, F.array(new.cast("int"))).otherwise(F.array_append(acc["part"], new.cast("int"))).alias("part"),
                F.when(big, F.array_append(acc["full"], acc["part"])).otherwise(acc["full"]).alias("full"))

        return let(F.when(acc["last"] == 0, F.least(wanted, F.lit(2))).otherwise(F.least(wanted, acc["last"] + 1)), put)

    def relevel(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x: x["level"]), lambda n: n > 0)
        levels = F.aggregate(heads, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["part"]))
        marks = F.transform(
            F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["level"].alias("level"))),
                     lambda x: x["level"] > 0), lambda x: x["i"])
        heading_lines = F.zip_with(marks, levels, lambda i, n: F.struct(
            i.alias("i"), F.concat(F.repeat(F.lit("#"), n), F.lit(" "), F.regexp_extract(
                F.get(lines, i)["text"], text_re, 1)).alias("text")))
        others = F.filter(F.transform(lines, lambda x, i: F.struct(
            i.alias("i"), F.when(x["level"] == 0, x["text"]).alias("text"))), lambda x: x["text"].isNotNull())
        return F.array_join(F.transform(
            F.sort_array(F.concat(heading_lines, others)), lambda x: x["text"]), "\n")

    return let(F.transform(F.split(markdown, "\n"), line), relevel)


# Words of buttons and of interface messages that stand alone on a line.
BUTTON_WORDS = ("Share", "Download", "Cite", "PDF", "Export", "Print")
INTERFACE_LINES = ("Loading...", "Please wait", "Click here")


# L5
def strip_interface_residue(markdown: Column) -> Column:
    """Drop button words, interface messages and rules alone on a line, control characters, empty links."""
    words = "|".join(w.replace(".", r"\.") for w in BUTTON_WORDS + INTERFACE_LINES)
    x = F.regexp_replace(markdown, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", "")
    kept = F.filter(F.split(x, "\n"), lambda line: ~strip(line).rlike(rf"^(?:{words}|-[- ]*)$"))
    joined = F.array_join(kept, "\n")
    joined = F.regexp_replace(joined, r"!?\[[^\]]*\]\(\s*\)", "")
    return F.regexp_replace(joined, r"!?\[\]\([^)]*\)", "")


def cleaned(markdown: Column, config: PipelineConfig) -> Column:
    return regex_clean(markdown, config.include_images, config.strict_clean)
