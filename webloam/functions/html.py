"""HTML as an array of tokens inside the row: cutting elements and rendering Markdown.

Everything here is page-local, so it is written as Column -> Column functions over
one ``array<string>`` of tokens. Pages are never exploded or shuffled for it: at
scale the page chain is one map-only stage, whatever the distribution of the pages.

Limits: mis-nested tags follow the level of their own tag name, not a browser's
repair. The end tags that HTML lets an author leave out are implied.
"""

from __future__ import annotations

from html.entities import html5
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloam.functions.text import UNI, WS, collapse_ws, let, strip

# One token: comment, whole script or style element, tag, declaration, run of text, lone "<".
# Inside a tag a quote opens a value only behind "=", so ">" in a value does not end the tag.
# Outside of values a tag ends at the next "<" at the latest: one that is never closed is text, found out in linear time.
TOKEN_RE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^<>]*+>.*?(?:</script\s*>|\z)"
    r"|<style\b[^<>]*+>.*?(?:</style\s*>|\z)"
    r"""|</?[a-z][^<>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?[^<>=]*+)*+>"""
    r"|</?[a-z][^<>]*+>"
    r"|<![^<>]*+>"
    r"|[^<]+"
    r"|<"
)

# Elements without content, elements pruned as page furniture, class and id marks.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr")
PRUNED_TAGS = ("nav", "footer", "header", "aside", "script", "style", "noscript", "form",
               "iframe", "svg", "canvas", "video", "audio")
PRUNED_MARKS = ("cookie", "widget", "popup", "modal", "banner", "advert", "sidebar", "comment",
                "share", "social", "newsletter", "subscribe", "related", "recommended",
                "breadcrumb", "pagination", "menu", "navbar", "toolbar")
SCRUBBED_TAGS = ("script", "style", "svg", "path", "noscript", "meta", "link")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Tags that start a new block of text.
BOUNDARY_TAGS = (
    "p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "td", "th",
    *HEADING_TAGS, "blockquote", "pre", "br", "hr", "title", "body", "nav", "header", "footer",
    "aside", "form", "fieldset", "figure", "figcaption", "dl", "dt", "dd", "address", "option",
)
# Tags whose start or end decides what the following blocks are.
CONTEXT_TAGS = (*HEADING_TAGS, "li", "td", "th", "pre")
CONTEXT_EDGES = ("ul", "ol", "table", "tr")
# Elements whose end tag cannot be left out: their end tag ends anything still open inside.
CONTAINER_TAGS = ("html", "body", "div", "section", "article", "main", "aside", "nav", "header",
                  "footer", "ul", "ol", "dl", "table", "form", "blockquote")
# Starts that imply the end of an open paragraph.
ENDS_P = ("p", "div", "section", "article", "main", "ul", "ol", "dl", "table", "form", "pre",
          "blockquote", "hr", "nav", "header", "footer", "aside", "figure", "address",
          *HEADING_TAGS)

_TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"


def html_tokens(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_RE), F.lit(0))


def text_tokens(html: Column) -> Column:
    """Tokens for rendering: control characters, which serve as marks there, are removed first."""
    return html_tokens(F.regexp_replace(html, r"[\p{Cntrl}&&[^\x{9}-\x{d}\x{1c}-\x{1f}]]", ""))


def tokens_html(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def is_close(tok: Column) -> Column:
    return tok.startswith("</")


def tag_name(tok: Column) -> Column:
    """Lower-cased tag name, empty for text, comments and declarations."""
    return F.when(
        tok.startswith("<"),
        F.translate(F.regexp_extract(tok, _TAG_NAME, 1), ascii_uppercase, ascii_lowercase)
    ).otherwise(F.lit(""))


def level_step(tok: Column, tag: Column) -> Column:
    """+1 for a start tag, -1 for an end tag, 0 for everything that stands alone."""
    return (
        F.when(tag == "", F.lit(0))
        .when(is_close(tok), F.lit(-1))
        .when(tag.isin(*VOID_TAGS, "script", "style") | tok.endswith("/>"), F.lit(0))
        .otherwise(F.lit(1))
    )


def attribute(tok: Column, name: str) -> Column:
    """Raw value of an attribute of a start tag, empty when it has none."""
    raw = F.regexp_extract(
        tok, rf"""(?is)^<[a-z][^>]*?[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return let(raw, lambda x: F.when(
        x.startswith('"') | x.startswith("'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def has_attribute(tok: Column, name: str) -> Column:
    return tok.rlike(rf"""(?i)^<[a-z][^>]*?[\s"'/]{name}\s*=""")


# F12
def has_class_containing(tok: Column, part: str) -> Column:
    """The classes of a start tag, joined by blanks and lower-cased, contain ``part``."""
    return tok.startswith("<") & F.contains(F.lower(attribute(tok, "class")), F.lit(part))


def has_pruned_mark(tok: Column) -> Column:
    """Class or id of a start tag contains one of the furniture marks."""
    marks = "|".join(PRUNED_MARKS)
    return tok.startswith("<") & F.contains(tok, F.lit("=")) & tok.rlike(
        rf"""(?is)^<[a-z][^>]*?\s(?:class|id)\s*=\s*"""
        rf"""(?:"[^"]*(?:{marks})|'[^']*(?:{marks})|[^\s>"']*(?:{marks}))""")


def is_pruned_tag(tok: Column) -> Column:
    return tag_name(tok).isin(*PRUNED_TAGS) & ~is_close(tok)


def is_scrubbed_tag(tok: Column) -> Column:
    return tag_name(tok).isin(*SCRUBBED_TAGS) & ~is_close(tok)


_GAPS = "array<struct<s:int,n:int>>"
#: Items that are folded at once.
_RUN = 128


def _gap(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), (stop - start).cast("int").alias("n"))


def swept(items: Column, state: Column, kind: str, step, finish=lambda state, rows: rows) -> Column:
    """What ``step(state, item)``, a struct(state, out), puts out for the items in order; ``out`` is an array of type ``kind``.

    A fold copies all it holds for every item. So items are folded in runs that hold their own rows only, and the runs are
    folded after each other: a page with very many items does not copy all rows for each of them.
    """
    none = F.array().cast(kind)
    both = lambda state, rows: F.struct(state.alias("state"), rows.alias("rows"))

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda r: both(r["state"], F.concat(acc["rows"], r["out"])))

    def run(acc: Column, xs: Column) -> Column:
        return let(F.aggregate(xs, both(acc["state"], none), one), lambda r: both(r["state"], F.concat(acc["rows"], r["rows"])))

    def work(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _RUN).cast("int")), lambda k: F.slice(xs, k * _RUN + 1, F.lit(_RUN)))
        return F.aggregate(F.when(F.size(xs) > 0, runs).otherwise(F.slice(runs, 1, 0)), both(state, none), run, lambda acc: finish(acc["state"], acc["rows"]))

    return let(items, work)


def drop_elements(tokens: Column, mark) -> Column:
    """Tokens without the elements whose start tag satisfies ``mark``, content included.

    One pass over the tags remembers the gaps between the removed elements; the kept
    tokens are slices at those gaps.
    """
    def describe(tok: Column, i: Column) -> Column:
        return let(
            tag_name(tok),
            lambda tag: F.struct(
                i.alias("i"), tag.alias("tag"), level_step(tok, tag).alias("d"),
                ((tag != "") & ~is_close(tok) & mark(tok)).alias("m")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inner"), F.lit("").alias("tag"), F.lit(0).alias("at"))
    none = F.array().cast(_GAPS)

    def implied_end(acc: Column, t: Column) -> Column:
        opens, inner0, own = t["d"] >= 0, acc["inner"] == 0, acc["tag"]
        return (acc["depth"] > 0) & (t["tag"] != "") & (
            ((own == "p") & opens & inner0 & t["tag"].isin(*ENDS_P))
            | (opens & inner0 & (
                ((own == "li") & (t["tag"] == "li"))
                | (own.isin("td", "th") & t["tag"].isin("td", "th", "tr"))
                | ((own == "tr") & (t["tag"] == "tr"))
                | (own.isin("dt", "dd") & t["tag"].isin("dt", "dd"))
                | ((own == "option") & (t["tag"] == "option"))
                | ((own == "head") & (t["tag"] == "body"))))
            | ((t["d"] == -1) & inner0 & (t["tag"] != own) & t["tag"].isin(*CONTAINER_TAGS)))

    def advance(acc: Column, t: Column, ended: Column) -> Column:
        open_ = (acc["depth"] > 0) & ~ended
        begins = ~open_ & t["m"]
        at = F.when(ended, t["i"]).otherwise(acc["at"])
        depth = (F.when(open_, acc["depth"] + F.when(t["tag"] == acc["tag"], t["d"]).otherwise(0))
                 .when(begins, t["d"]).otherwise(F.lit(0)))
        closes = open_ & (t["tag"] == acc["tag"]) & (acc["depth"] + t["d"] == 0)
        alone = begins & (t["d"] == 0)
        inner = F.when(
            open_ & (t["tag"] != acc["tag"]) & t["tag"].isin(*CONTAINER_TAGS), acc["inner"] + t["d"]
        ).when(open_, acc["inner"]).otherwise(F.lit(0))
        return F.struct(
            F.struct(
                depth.alias("depth"), inner.alias("inner"),
                F.when(begins, t["tag"]).otherwise(acc["tag"]).alias("tag"),
                F.when(closes | alone, t["i"] + 1).otherwise(at).alias("at")).alias("state"),
            F.when(begins, F.array(_gap(at, t["i"]))).otherwise(none).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        quiet = ((t["d"] == 0) | (acc["depth"] == 0)) & ~t["m"] & (t["tag"] != "hr")
        return F.when(quiet, F.struct(acc.alias("state"), none.alias("out"))).otherwise(
            let(implied_end(acc, t), lambda ended: advance(acc, t, ended)))

    def finish_with(n: Column):
        return lambda acc, gaps: F.concat(gaps, F.when(acc["depth"] > 0, none).otherwise(F.array(_gap(acc["at"], n))))

    def cut(toks: Column) -> Column:
        tags = F.filter(F.transform(toks, describe), lambda t: t["tag"] != "")
        gaps = swept(tags, start, _GAPS, step, finish_with(F.size(toks)))
        return F.flatten(F.transform(gaps, lambda g: F.slice(toks, g["s"] + 1, g["n"])))

    return let(tokens, cut)


_PAIRS = "array<struct<s:int,e:int,depth:int>>"


def elements(tokens: Column) -> Column:
    """Elements of a page in document order: ``array<struct<s, e, depth>>`` of token indexes.

    ``s`` is the start tag, ``e`` the end tag or the last token inside when the end tag is
    left out. One pass keeps the stack of open elements (innermost first). A start tag may
    imply the end of an open p, li, td, th, tr, dt, dd or option; an end tag ends what is
    still open inside its element; an end tag of a plain element never crosses a container;
    an end tag without a start is ignored.
    """
    def reach(tags: Column, names: tuple[str, ...], barrier: tuple[str, ...]) -> Column:
        """Depth in the stack of the outermost of ``names`` before any of ``barrier``."""
        walls = [F.array_position(tags, b) for b in barrier]
        wall = F.array_min(F.filter(F.array(*walls), lambda w: w > 0))
        hits = [F.array_position(tags, n) for n in names]
        return F.coalesce(F.array_max(F.filter(
            F.array(*hits), lambda h: (h > 0) & ((h < wall) | wall.isNull()))), F.lit(0))

    def pops(tags: Column, t: Column) -> Column:
        tag = t["tag"]
        at = F.array_position(tags, tag)
        blocked = F.arrays_overlap(F.slice(tags, 1, F.greatest(at - 1, F.lit(0)).cast("int")),
                                   F.array(*[F.lit(c) for c in CONTAINER_TAGS]))
        closing = F.when((at > 0) & (tag.isin(*CONTAINER_TAGS) | ~blocked), at).otherwise(F.lit(0))
        opening = (
            F.when(tag.isin(*ENDS_P), reach(tags, ("p",), ("table", "td", "th")))
            .when(tag == "li", reach(tags, ("li",), ("ul", "ol")))
            .when(tag.isin("td", "th"), reach(tags, ("td", "th"), ("table",)))
            .when(tag == "tr", reach(tags, ("td", "th", "tr"), ("table",)))
            .when(tag.isin("dt", "dd"), reach(tags, ("dt", "dd"), ("dl",)))
            .when(tag == "option", reach(tags, ("option",), ("select",)))
            .when(tag == "body", reach(tags, ("head",), ("body",)))
            .otherwise(F.lit(0)))
        return F.when(t["d"] == -1, closing).otherwise(opening).cast("int")

    def describe(tok: Column, i: Column) -> Column:
        return let(tag_name(tok), lambda tag: F.struct(
            i.alias("i"), tag.alias("tag"), level_step(tok, tag).alias("d")))

    def closed(acc: Column, count: Column, end_of) -> Column:
        size = F.size(acc["pos"])
        return F.transform(F.slice(acc["pos"], F.lit(1), count), lambda s, j: F.struct(
            s.alias("s"), end_of(j).cast("int").alias("e"), (size - j).cast("int").alias("depth")))

    def advance(acc: Column, t: Column, n: Column) -> Column:
        size = F.size(acc["pos"])
        done = closed(acc, n, lambda j: F.when((t["d"] == -1) & (j == n - 1), t["i"]).otherwise(t["i"] - 1))
        own = F.struct(t["i"].alias("s"), t["i"].alias("e"), (size - n + 1).cast("int").alias("depth"))
        tags = F.slice(acc["tags"], n + 1, size - n)
        pos = F.slice(acc["pos"], n + 1, size - n)
        return F.struct(
            F.struct(
                F.when(t["d"] == 1, F.concat(F.array(t["tag"]), tags)).otherwise(tags).alias("tags"),
                F.when(t["d"] == 1, F.concat(F.array(t["i"]), pos)).otherwise(pos).alias("pos")).alias("state"),
            F.when(t["d"] == 0, F.concat(done, F.array(own))).otherwise(done).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        return let(pops(acc["tags"], t), lambda n: advance(acc, t, n))

    def finish_with(n: Column):
        return lambda acc, pairs: F.sort_array(F.concat(pairs, closed(acc, F.size(acc["pos"]), lambda j: n - 1)))

    start = F.struct(F.array().cast("array<string>").alias("tags"), F.array().cast("array<int>").alias("pos"))
    return let(tokens, lambda toks: swept(
        F.filter(F.transform(toks, describe), lambda t: t["tag"] != ""), start, _PAIRS, step, finish_with(F.size(toks))))


# HTML 5 names by their first letter, each with what it stands for; a map is searched from its start, so they are kept short.
_LETTERS = range(ord("A"), ord("z") + 1)
_NAMES = ["\x1e".join(f"{name[:-1]}\x1f{text}" for name, text in html5.items() if name.endswith(";") and ord(name[0]) == letter) for letter in _LETTERS]
# Names that need no semicolon, the longest first.
_BARE_NAMES = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
# What references to 128 to 159 mean: Windows-1252, where it has a character.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Character references of HTML 5, each decoded once; control characters give nothing.

    The longest name counts. Some names, and numbers, need no semicolon: ``&notit`` is ``¬it``, ``&notin;`` is ``∉``. In an attribute
    a name without one stays as it is before a letter, a digit or ``=``, as in the query of a URL.
    """
    def numeric(ref: Column) -> Column:
        digits = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX]([0-9a-fA-F]{1,12})", 1), 16, 10)) \
            .otherwise(F.regexp_extract(ref, "^&#([0-9]{1,12})", 1))
        return let(digits.try_cast("long"), lambda n: F.when(
            n.between(1, 8) | n.between(14, 27) | (n == 127), F.lit(""))
            .when(n.between(128, 159), F.substring(F.lit(_WINDOWS), (n - 127).cast("int"), F.lit(1)))
            .when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")))

    maps = F.array(*[F.str_to_map(F.lit(names or "\x1f"), F.lit("\x1e"), F.lit("\x1f")) for names in _NAMES])

    def meaning(name: Column) -> Column:
        return F.try_element_at(F.get(maps, F.ascii(name) - _LETTERS[0]), name)

    def bare(part: Column) -> Column:
        """The part with the name at its start decoded, if one is that needs no semicolon."""
        return let(F.regexp_extract(part, f"^&({_BARE_NAMES})", 1), lambda name: let(
            F.substring(part, F.length(name) + 2, F.length(part)), lambda rest: F.when(
                (name == "") | (rest.rlike("^[a-zA-Z0-9=]") if attribute else F.lit(False)), part).otherwise(F.concat(meaning(name), rest))))

    def named(part: Column) -> Column:
        whole = F.when(part.endswith(";"), meaning(F.regexp_extract(part, "^&([a-zA-Z0-9]+);$", 1)))
        return let(whole, lambda text: F.when(text.isNotNull(), text).otherwise(bare(part)))

    def one(part: Column) -> Column:
        return (
            F.when(~part.startswith("&"), part)
            .when(part.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])"), numeric(part))
            .when(part.rlike("^&[a-zA-Z]"), named(part))
            .otherwise(part))

    parts = F.lit("&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*[;=]?|[^&]+|&")
    return let(text, lambda x: F.when(F.contains(x, F.lit("&")), F.array_join(
        F.transform(F.regexp_extract_all(x, parts, F.lit(0)), one), "")).otherwise(x))


# Marks inside a rendered page; the tokens come from text_tokens and hold no such characters.
_CTX, _CTX_END, _BLOCK = "\x01", "\x08", "\x02"
_HREF, _HREF_END, _LINK_END = "\x03", "\x04", "\x05"
_BODY, _TITLE, _TITLE_END = "\x0e", "\x0f", "\x10"
_BOLD, _ITALIC, _CODE = "\x11", "\x12", "\x13"
INLINE = {"b": _BOLD, "strong": _BOLD, "em": _ITALIC, "i": _ITALIC, "code": _CODE, "kbd": _CODE}
# Elements whose edges number list items, count cells and open quotes: start and end are blocks without text, named as the tag or "/tag".
EDGES = ("ul", "ol", "table", "blockquote")
_LINK_RE = r"\x{3}([^\x{3}\x{4}]*)\x{4}([^\x{3}\x{5}]*)\x{5}"


def _piece(tok: Column) -> Column:
    """What one token adds to the rendered page."""
    def payload(tag: Column) -> Column:
        """The part of the token that is text and may hold character references."""
        return (
            F.when(tag == "a", attribute(tok, "href"))
            .when(tag == "img", F.concat(F.lit("!["), attribute(tok, "alt"), F.lit("]("), attribute(tok, "src"), F.lit(")")))
            .otherwise(F.lit("")))

    def tag_piece(tag: Column, text: Column) -> Column:
        close = is_close(tok)
        return (
            F.when(tag == "", F.lit(""))
            .when(tag.isin(*CONTEXT_TAGS) & ~close, F.concat(F.lit(_CTX), tag, F.lit(_CTX_END)))
            .when((tag == "tr") & ~close, F.lit(_CTX + "tr" + _CTX_END))
            .when(tag.isin(*EDGES), F.concat(
                F.lit(_CTX), F.when(close, F.lit("/")).otherwise(F.lit("")), tag, F.lit(_CTX_END + _CTX + _CTX_END)))
            .when(tag.isin(*CONTEXT_TAGS, *CONTEXT_EDGES), F.lit(_CTX + _CTX_END))
            .when(tag.isin(*INLINE), F.translate(F.substring(tag, 1, 1), "bseick", _BOLD + _BOLD + _ITALIC + _ITALIC + _CODE + _CODE))
            .when((tag == "body") & ~close, F.lit(_BODY))
            .when(tag == "title", F.when(close, F.lit(_TITLE_END)).otherwise(F.lit(_TITLE)))
            .when((tag == "a") & close, F.lit(_LINK_END))
            .when(tag == "a", F.when(
                has_attribute(tok, "href"), F.concat(F.lit(_HREF), text, F.lit(_HREF_END))).otherwise(F.lit("")))
            .when(tag == "img", text)
            .when(tag.isin(*BOUNDARY_TAGS), F.lit(_BLOCK))
            .otherwise(F.lit("")))

    is_tag = tok.startswith("<") & (F.length(tok) > 1)
    named = let(F.when(is_tag, tag_name(tok)), lambda tag: F.struct(
        tag.alias("tag"), F.when(tag.isNull(), tok).otherwise(payload(tag)).alias("raw")))
    return let(named, lambda n: F.when(n["tag"].isNull(), decode_entities(n["raw"])).otherwise(
        let(decode_entities(n["raw"], attribute=True), lambda text: tag_piece(n["tag"], text))))


def page_blocks(tokens: Column) -> Column:
    """Text blocks of a page: ``array<struct<ctx, vis, md, words, density, mark, quoted>>``, empty ones dropped.

    ``ctx`` is the element the block stands in (heading, li, td, th, pre), ``tr`` for a row mark; ``density`` is the share of its
    non-blank characters that sit in links. ``mark`` is what a list item starts with, and the number of a cell in the first row
    of its table; ``quoted`` how many quotes the block lies in.
    """
    rendered = F.array_join(F.transform(tokens, _piece), "")
    body = let(F.substring_index(rendered, _BODY, -1), lambda x: F.when(
        F.contains(x, F.lit(_TITLE)), F.regexp_replace(x, r"\x{f}[^\x{10}]*\x{10}", "")).otherwise(x))

    def segment(seg: Column) -> Column:
        has_ctx = F.contains(seg, F.lit(_CTX_END))
        ctx = F.when(has_ctx, F.substring_index(seg, _CTX_END, 1)).otherwise(F.lit(""))
        rest = F.substring_index(seg, _CTX_END, -1)
        # blanks count in preformatted text, and blocks in it are lines
        return let(ctx, lambda c: F.when(c == "pre", F.array(F.struct(c.alias("ctx"), F.replace(rest, F.lit(_BLOCK), F.lit("\n")).alias("raw")))).otherwise(
            F.transform(F.split(F.regexp_replace(rest, UNI + WS + "+", " "), _BLOCK), lambda b: F.struct(c.alias("ctx"), b.alias("raw")))))

    def bare(x: Column) -> Column:
        return F.length(F.replace(x, F.lit(" "), F.lit("")))

    def tidy(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, " {2,}", " "))

    marks = r"[\x{3}-\x{5}\x{f}-\x{13}]"

    def without(x: Column, pattern: str) -> Column:
        return F.regexp_replace(F.regexp_replace(x, pattern, ""), marks, "")

    def emphasis(x: Column) -> Column:
        """Marks in pairs around text become those of Markdown."""
        for mark, code in (("13", "`"), ("11", "**"), ("12", "*")):
            x = F.regexp_replace(x, rf"\x{{{mark}}}( *)([^\x{{{mark}}} ](?:[^\x{{{mark}}}]*[^\x{{{mark}}} ])?)( *)\x{{{mark}}}", f"$1{code}$2{code}$3")
        return x

    def measure(b: Column) -> Column:
        raw = b["raw"]
        marked = raw.rlike(marks)
        start_mark = r"\x{3}[^\x{4}]*\x{4}"
        preformatted = F.btrim(without(raw, start_mark), F.lit("\r\n"))
        vis = F.when(b["ctx"] == "pre", tidy(F.regexp_replace(preformatted, UNI + WS + "+", " "))) \
            .when(marked, tidy(without(raw, start_mark))).otherwise(F.trim(raw))
        md = F.when(b["ctx"] == "pre", F.concat(F.lit("```\n"), preformatted, F.lit("\n```"))) \
            .when(marked, tidy(without(emphasis(F.regexp_replace(raw, _LINK_RE, r"[$2]($1)")), start_mark)))
        linked = F.when(marked, bare(F.regexp_replace(F.array_join(F.regexp_extract_all(raw, F.lit(_LINK_RE), F.lit(2)), ""), marks, ""))) \
            .otherwise(F.lit(0))
        return let(vis, lambda v: let(bare(v), lambda n: F.struct(
            b["ctx"].alias("ctx"), v.alias("vis"), F.coalesce(md, v).alias("md"),
            F.when(n == 0, F.lit(0)).otherwise(F.length(v) - n + 1).alias("words"),
            F.when(n == 0, F.lit(0.0)).otherwise(linked / n).alias("density"))))

    blocks = F.flatten(F.transform(F.split(body, _CTX), segment))
    found = F.filter(F.transform(blocks, measure), lambda b: (b["vis"] != "") | (b["ctx"] == "tr") | _is_edge(b))
    return let(found, _numbered)


def _is_edge(b: Column) -> Column:
    return b["ctx"].isin(*EDGES, *[f"/{t}" for t in EDGES])


_MARKED = "array<struct<mark:string,quoted:int>>"


def _numbered(blocks: Column) -> Column:
    """Blocks without the edges of lists, tables and quotes, with ``mark`` and ``quoted``.

    One fold carries the open lists (the next number of each, -1 for one without numbers), how many quotes are open, and the
    rows and cells of the table so far. Pages without numbers, tables and quotes need no fold.
    """
    own = F.filter(blocks, lambda b: ~_is_edge(b))
    plain = F.transform(own, lambda b: F.struct(F.when(b["ctx"] == "li", F.lit("- ")).otherwise(F.lit("")).alias("mark"), F.lit(0).alias("quoted")))

    def step(state: Column, b: Column) -> Column:
        ctx, lists, top = b["ctx"], state["lists"], F.get(state["lists"], F.lit(0))
        opens, closes = ctx.isin("ul", "ol"), ctx.isin("/ul", "/ol")
        counted = (ctx == "li") & (top > 0)
        rest = F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0)))
        cell = ctx.isin("td", "th")
        rows = F.when(ctx.isin("table", "/table"), F.lit(0)).when(ctx == "tr", state["rows"] + 1).otherwise(state["rows"])
        cells = F.when(ctx == "tr", F.lit(0)).otherwise(state["cells"] + cell.cast("int"))
        mark = F.when(counted, F.concat(top.cast("string"), F.lit(". "))).when(ctx == "li", F.lit("- ")) \
            .when(cell & (rows == 1), cells.cast("string")).otherwise(F.lit(""))
        quotes = F.greatest(state["quotes"] + F.when(ctx == "blockquote", 1).when(ctx == "/blockquote", -1).otherwise(0), F.lit(0))
        return F.struct(
            F.struct(
                F.when(opens, F.concat(F.array(F.when(ctx == "ol", 1).otherwise(-1)), lists)).when(closes, rest)
                .when(counted, F.concat(F.array(top + 1), rest)).otherwise(lists).alias("lists"),
                rows.alias("rows"), cells.alias("cells"), quotes.alias("quotes")).alias("state"),
            F.when(_is_edge(b), F.array().cast(_MARKED)).otherwise(F.array(F.struct(mark.alias("mark"), quotes.alias("quoted")))).alias("out"))

    start = F.struct(F.array().cast("array<int>").alias("lists"), F.lit(0).alias("rows"), F.lit(0).alias("cells"), F.lit(0).alias("quotes"))
    folded = F.exists(blocks, lambda b: b["ctx"].isin("ol", "table", "blockquote"))
    marks = F.when(folded, swept(blocks, start, _MARKED, step)).otherwise(plain)
    return F.zip_with(own, marks, lambda b, m: F.struct(
        *[b[c].alias(c) for c in ("ctx", "vis", "md", "words", "density")], m["mark"].alias("mark"), m["quoted"].alias("quoted")))


def _is_cell(b: Column) -> Column:
    return F.coalesce(b["ctx"].isin("td", "th"), F.lit(False))


def _is_heading(b: Column) -> Column:
    return b["ctx"].isin(*HEADING_TAGS)


def blocks_markdown(blocks: Column) -> Column:
    """Markdown of the blocks; NULL when nothing is left."""
    def drop_bare_rows(bs: Column) -> Column:
        return F.filter(bs, lambda b, i: (b["ctx"] != "tr") | _is_cell(F.get(bs, i + 1)))

    def render(bs: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            prev, prev2, nxt = F.get(bs, i - 1), F.get(bs, i - 2), F.get(bs, i + 1)
            row_start = F.coalesce(prev["ctx"] == "tr", F.lit(False))
            lead = F.when((i == 0) | (row_start & (i == 1)), F.lit(""))
            cell = F.concat(
                F.when(_is_cell(prev), F.lit(" | ")).otherwise(F.concat(
                    lead.when(row_start & _is_cell(prev2) & (b["mark"] == ""), F.lit("\n")).otherwise(F.lit("\n\n")), F.lit("| "))),
                F.replace(F.replace(b["md"], F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" ")),
                F.when(_is_cell(nxt), F.lit("")).otherwise(F.concat(F.lit(" |"), F.when(
                    b["mark"] != "", F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), b["mark"].cast("int")))).otherwise(F.lit("")))))
            plain = F.concat(
                lead.when((b["ctx"] == "li") & F.coalesce(prev["ctx"] == "li", F.lit(False)), F.lit("\n"))
                .when((b["quoted"] > 0) & F.coalesce(prev["quoted"] > 0, F.lit(False)), F.concat(F.lit("\n"), F.repeat(F.lit(">"), b["quoted"]), F.lit("\n")))
                .otherwise(F.lit("\n\n")),
                F.when(b["quoted"] > 0, F.concat(F.repeat(F.lit(">"), b["quoted"]), F.lit(" "))).otherwise(F.lit("")),
                F.when(_is_heading(b), F.concat(
                    F.repeat(F.lit("#"), F.right(b["ctx"], F.lit(1)).cast("int")), F.lit(" ")))
                .when(b["ctx"] == "li", b["mark"]).otherwise(F.lit("")),
                F.when(b["quoted"] > 0, F.replace(b["md"], F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(">"), b["quoted"]), F.lit(" ")))).otherwise(b["md"]))
            return F.when(b["ctx"] == "tr", F.lit("")).when(_is_cell(b), cell).otherwise(plain)

        return F.array_join(F.transform(bs, one), "")

    text = let(let(blocks, drop_bare_rows), render)
    return let(text, lambda t: F.when(t != "", t))


def _is_plain(b: Column) -> Column:
    return F.coalesce((b["ctx"] != "tr") & (_is_heading(b) | (b["density"] <= 0.5)), F.lit(False))


def keep_blocks(blocks: Column, main: Column, min_words: int) -> Column:
    """The blocks that count.

    Of a main text: headings, blocks of few links, and link-rich blocks between two of
    those. Of a whole page: headings and blocks of at least ``min_words`` words.
    """
    def choose(bs: Column) -> Column:
        return F.filter(bs, lambda b, i: (b["ctx"] == "tr") | _is_heading(b) | F.when(
            main, _is_plain(b) | ((b["density"] <= 0.75) & _is_plain(F.get(bs, i - 1)) & _is_plain(F.get(bs, i + 1)))
        ).otherwise(b["words"] >= min_words))

    return let(blocks, choose)


def markdowns(sources: Column, min_words: int = 10) -> Column:
    """Markdown of every ``struct<tokens, main>`` of an array, NULL where nothing is left."""
    return F.transform(sources, lambda s: blocks_markdown(
        keep_blocks(page_blocks(s["tokens"]), s["main"], min_words)))


def _source(tokens: Column, main: bool) -> Column:
    return F.struct(tokens.alias("tokens"), F.lit(main).alias("main"))


# D9
def main_markdown(tokens: Column) -> Column:
    return F.get(markdowns(F.array(_source(tokens, True))), F.lit(0))


# D10
def whole_page_markdown(tokens: Column, min_words: int = 10) -> Column:
    return F.get(markdowns(F.array(_source(tokens, False)), min_words), F.lit(0))


def both_markdowns(pruned: Column, whole: Column, min_words: int = 10) -> Column:
    """array(main text of the pruned tokens, text of the whole page)."""
    return markdowns(F.array(_source(pruned, True), _source(whole, False)), min_words)


# D12
def page_title(tokens: Column) -> Column:
    """Text of the first title element; NULL when there is none or it is empty."""
    def find(toks: Column) -> Column:
        at = F.array_position(F.transform(toks, lambda t: F.when(
            is_close(t), F.lit("")).otherwise(tag_name(t))), F.lit("title"))
        text = F.get(toks, at.cast("int"))
        return F.when((at > 0) & ~text.startswith("<"), text)

    return let(collapse_ws(decode_entities(let(tokens, find))), lambda t: F.when(t != "", t))


def og_title(tokens: Column) -> Column:
    """Content of the first ``og:title`` meta element; NULL when there is none or it is empty."""
    hits = F.filter(tokens, lambda t: t.startswith("<") & (tag_name(t) == "meta")
                    & (attribute(t, "property") == "og:title"))
    content = collapse_ws(decode_entities(attribute(F.get(hits, F.lit(0)), "content"), attribute=True))
    return let(content, lambda t: F.when(t != "", t))


# G6
def links_of(tokens: Column) -> Column:
    """Decoded href of every link, in order."""
    hits = F.filter(tokens, lambda t: t.startswith("<") & (tag_name(t) == "a") & ~is_close(t)
                    & has_attribute(t, "href"))
    return F.transform(hits, lambda t: strip(decode_entities(attribute(t, "href"), attribute=True)))


def count_images(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.startswith("<") & (tag_name(t) == "img")))


# D14
def scrub_tokens(tokens: Column) -> Column:
    """Without scripts, styles and other dead weight; style and data-* attributes stripped."""
    quoted = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
    rules = rf"""(?i)\s(?:style|data-[^\s=>"'/]*)(?:{quoted})?(?=[\s/>])"""

    def one(tok: Column) -> Column:
        return F.when(tok.rlike("(?i)^<[a-z][^>]*\\s(?:style|data-)"), F.regexp_replace(tok, rules, "")).otherwise(tok)

    return F.transform(drop_elements(tokens, is_scrubbed_tag), one)
