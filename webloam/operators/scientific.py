"""Scientific pages: abstracts, keywords and body sections rescued before extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions import html as H
from webloam.functions import scientific as S
from webloam.functions.outcome import is_scientific_site
from webloam.functions.reuse import per_application
from webloam.functions.text import inject_section


# The expressions of the steps, over fixed column names.
@per_application
def _tree() -> Column:
    return S.page_tree(H.html_tokens(F.col("html")))


@per_application
def _abstracts(min_text: int) -> Column:
    return S.abstracts(F.col("_tree"), min_text)


@per_application
def _keywords(tree: str) -> Column:
    return S.keywords(F.col(tree))


@per_application
def _body(tree: str, min_text: int) -> Column:
    return S.body_sections(F.col(tree), min_text)


def with_tree(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_tree", _tree())


def _one_section_per_row(df: DataFrame, state: str) -> DataFrame:
    # The outer form keeps the optimizer from extracting twice, the second time in an inferred filter.
    return df.select("page_id", F.posexplode_outer(F.col(state)["out"]).alias("ordinal", "section")) \
        .filter(F.col("section").isNotNull())


# D5
def extract_abstracts(pages: DataFrame, min_text: int = S.MIN_TEXT) -> DataFrame:
    """(page_id, ordinal, section): the abstracts of each page with more than ``min_text`` characters, deepest first."""
    df = with_tree(pages).withColumn("_abs", _abstracts(min_text))
    return _one_section_per_row(df, "_abs")


# D6
def extract_keywords(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, section): the keyword sections of each page."""
    df = with_tree(pages).withColumn("_kw", _keywords("_tree"))
    return _one_section_per_row(df, "_kw")


# D7
def extract_body_sections(pages: DataFrame, min_text: int = S.MIN_TEXT) -> DataFrame:
    """(page_id, ordinal, section): headed sections of the article body of each page; all paragraphs of more than ``min_text`` characters."""
    df = with_tree(pages).withColumn("_body", _body("_tree", min_text))
    return _one_section_per_row(df, "_body")


# D8
def scientific_preprocess(pages: DataFrame, min_text: int = S.MIN_TEXT) -> DataFrame:
    """``html`` without the extracted parts and ``scientific_content`` for scientific hosts.

    Other pages keep their html and get an empty string; they never build a tree.
    """
    scientific = F.col("is_scientific")
    return (
        pages.withColumn("is_scientific", is_scientific_site(F.col("url")))
        .withColumn("_tree", F.when(scientific, _tree()))
        .withColumn("_abs", F.when(scientific, _abstracts(min_text)))
        .withColumn("_kw", F.when(scientific, _keywords("_abs.tree")))
        .withColumn("_body", F.when(scientific, _body("_kw.tree", min_text)))
        .withColumn("html", F.when(scientific, H.tokens_html(F.col("_body.tree.toks"))).otherwise(F.col("html")))
        .withColumn("scientific_content", F.when(scientific, F.array_join(F.concat(
            F.col("_abs")["out"], F.col("_kw")["out"], F.col("_body")["out"]), "\n\n")).otherwise(F.lit("")))
        .drop("_tree", "_abs", "_kw", "_body")
    )


# J5
def reinject_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Put extracted sections (page_id, scientific_content) behind the title of their document."""
    return (
        docs.join(sections.select("page_id", "scientific_content"), "page_id", "left")
        .withColumn("markdown", inject_section(F.col("markdown"), F.col("scientific_content")))
    )
