"""Page operators: token table, pruning, extraction, titles, counts.

All of them are map-only. A page is one row, its tokens live in that row, and no
exchange is needed whatever the distribution of page sizes or keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions import html as H
from webloam.functions.reuse import per_application
from webloam.functions.text import let, url_host


@per_application
def _token_rows() -> Column:
    def rows(toks: Column) -> Column:
        def token(tok: Column, i: Column) -> Column:
            return let(H.tag_name(tok), lambda tag: F.struct(
                i.alias("pos"), tok.alias("tok"), tag.alias("tag"), H.level_step(tok, tag).alias("d")))

        def slots(els: Column) -> Column:
            """Elements and fillers in token order, one per token."""
            fill = F.filter(
                F.transform(toks, lambda tok, i: F.when(
                    (H.tag_name(tok) == "") | H.is_close(tok),
                    F.struct(i.alias("s"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("int").alias("depth")))),
                lambda x: x.isNotNull())
            return F.sort_array(F.concat(els, fill))

        return F.zip_with(F.transform(toks, token), slots(H.elements(toks)), lambda t, e: F.struct(
            t["pos"].alias("pos"), t["tok"].alias("tok"), t["tag"].alias("tag"), t["d"].alias("d"),
            e["e"].alias("end_pos"), e["depth"].alias("depth")))

    return let(H.html_tokens(F.col("html")), rows)


# D1
def tokenize_html(pages: DataFrame) -> DataFrame:
    """One row per token: (page_id, pos, tok, tag, d, end_pos, depth).

    ``d`` is the level step (+1 start, -1 end, 0 alone). Start tags carry ``end_pos``,
    the last position of their element, and ``depth``: the descendants of an element
    are the positions between ``pos`` and ``end_pos``.
    """
    # The outer form keeps the optimizer from making the tokens a second time in an inferred filter.
    return pages.select("page_id", F.inline_outer(_token_rows())).filter(F.col("pos").isNotNull())


def _with_tokens(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_tokens", H.html_tokens(F.col("html")))


def _prune(tokens: Column, tags: bool, marks: bool) -> Column:
    def mark(tok: Column) -> Column:
        hit = H.is_pruned_tag(tok) if tags else F.lit(False)
        return hit | H.has_pruned_mark(tok) if marks else hit

    return H.drop_elements(tokens, mark)


@per_application
def _pruned_html(tags: bool, marks: bool) -> Column:
    return H.tokens_html(_prune(H.html_tokens(F.col("html")), tags, marks))


@per_application
def _main() -> Column:
    return H.main_markdown(pruned_tokens(H.text_tokens(F.col("html"))))


@per_application
def _whole(min_words: int) -> Column:
    return H.whole_page_markdown(H.text_tokens(F.col("html")), min_words)


@per_application
def _scrubbed() -> Column:
    return H.tokens_html(H.scrub_tokens(H.html_tokens(F.col("html"))))


# D2
def prune_tags(pages: DataFrame) -> DataFrame:
    """``html`` without navigation, scripts, forms, media and other furniture elements."""
    return pages.withColumn("html", _pruned_html(True, False))


# D3
def prune_class_id(pages: DataFrame) -> DataFrame:
    """``html`` without elements whose class or id names cookie notes, sharing, menus and the like."""
    return pages.withColumn("html", _pruned_html(False, True))


def pruned_tokens(tokens: Column) -> Column:
    return _prune(tokens, True, True)


# D4
def prune_dom(pages: DataFrame) -> DataFrame:
    """D2 and D3 in one pass. Comments stay, they are no elements."""
    return pages.withColumn("html", _pruned_html(True, True))


# D9
def extract_main_content(pages: DataFrame) -> DataFrame:
    """(page_id, main_markdown): main text of the pruned page, NULL when nothing is left."""
    return pages.select("page_id", _main().alias("main_markdown"))


# D10
def page_fallback_markdown(pages: DataFrame, min_words: int = 10) -> DataFrame:
    """(page_id, fallback_markdown): a supplied fallback, else the whole page without short blocks."""
    own = _whole(min_words)
    if "fallback_markdown" in pages.columns:
        own = F.coalesce(F.col("fallback_markdown"), own)
    return pages.select("page_id", own.alias("fallback_markdown"))


# D12
def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, page_title, og_title)."""
    toks = F.col("_tokens")
    return _with_tokens(pages).select(
        "page_id", H.page_title(toks).alias("page_title"), H.og_title(toks).alias("og_title"))


def link_counts(tokens: Column, url: Column) -> Column:
    """struct(internal, external, images); a link without a host of its own is internal."""
    def count(p: Column) -> Column:
        inside = F.size(F.filter(p["links"], lambda h: let(
            url_host(F.regexp_replace(h, "^//", "http://")), lambda host: (host == "") | (host == p["host"]))))
        return F.struct(inside.alias("internal"), (F.size(p["links"]) - inside).alias("external"))

    pair = let(F.struct(H.links_of(tokens).alias("links"), url_host(url).alias("host")), count)
    return let(pair, lambda c: F.struct(
        c["internal"].alias("internal"), c["external"].alias("external"), H.count_images(tokens).alias("images")))


# G6
def link_image_counts(pages: DataFrame) -> DataFrame:
    """(page_id, internal_links, external_links, links_count, images_count)."""
    return (
        _with_tokens(pages)
        .withColumn("_c", link_counts(F.col("_tokens"), F.col("url")))
        .select("page_id", F.col("_c.internal").alias("internal_links"), F.col("_c.external").alias("external_links"),
                (F.col("_c.internal") + F.col("_c.external")).alias("links_count"),
                F.col("_c.images").alias("images_count"))
    )


# D14
def scrub_html_for_prompt(pages: DataFrame) -> DataFrame:
    """``html`` without scripts, styles, vector images, meta and link elements, style and data-* attributes."""
    return pages.withColumn("html", _scrubbed())
