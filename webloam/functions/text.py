"""Text rules as Column -> Column functions (all JVM-side, no Python UDF).

Whitespace follows Python's idea of it (``str.strip``, ``\\s`` on str), which is
wider than Java's ASCII ``\\s``: the explicit class below is used throughout.
Groups are never repeated over lines without a possessive quantifier, because
Java's matcher recurses on such loops and a long text would overflow the stack.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python counts as whitespace, as text and as regex classes.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The classes for patterns that start with the flag UNI, under which \s means Unicode white space.
UNI = "(?U)"
WS = r"[\s\x{1c}-\x{1f}]"
WS_NO_NL = r"[\s\x{1c}-\x{1f}&&[^\n]]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column captured by a lambda may be inlined there by the optimizer and be evaluated
    per element; a lambda variable never is. The binding is a fold over no elements: the
    value is its start and the body its finish, which costs no array and no copy.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def collapse_ws(x: Column) -> Column:
    return strip(F.regexp_replace(x, UNI + WS + "+", " "))


# N1
def content_hash(markdown: Column, success: Column | None = None) -> Column:
    """SHA-256 hex of the UTF-8 text; NULL for failures and for empty text."""
    ok = F.length(markdown) > 0
    if success is not None:
        ok = ok & success
    return F.when(ok, F.sha2(markdown, 256))


# N2
def content_length(markdown: Column) -> Column:
    """Number of code points; NULL counts as empty."""
    return F.coalesce(F.length(markdown), F.lit(0)).cast("long")


# N10
def parse_pdf_date(value: Column) -> Column:
    """``D:YYYYMMDD[HH[mm[SS]]]`` to ISO text without zone; other text is kept, empty is NULL."""
    pattern = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?"

    def part(i: int) -> Column:
        found = F.regexp_extract(value, pattern, i)
        return F.when(found == "", F.lit("00")).otherwise(found)

    iso = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"),
                   part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    return F.when(F.length(value) == 0, F.lit(None)).when(value.rlike(pattern), iso).otherwise(value)


# What is taken out of PDF texts, pattern and replacement, in this order.
PDF_RULES = (
    (r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", ""),
    ("[ \t]+", " "),
    ("\n{3,}", "\n\n"),
)


# N11
def clean_pdf_text(text: Column) -> Column:
    for pattern, replacement in PDF_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


# N12, also the last rule of regex_clean
def clean_markdown(markdown: Column) -> Column:
    x = F.regexp_replace(markdown, "\n[ \t]+\n", "\n\n")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


# N13
def normalize_markdown_spacing(markdown: Column) -> Column:
    """One blank line around headings and between paragraphs, none at either end."""
    def line(x: Column) -> Column:
        bare = strip(x)
        return (F.when(bare == "", F.lit(""))
                .when(bare.startswith("#") & bare.contains(" "), F.concat(F.lit("\n"), x, F.lit("\n")))
                .otherwise(x))

    joined = F.array_join(F.transform(F.split(markdown, "\n"), line), "\n")
    return F.btrim(F.regexp_replace(joined, "\n{3,}", "\n\n"), F.lit("\n"))


# Marks of Markdown and what is left of them, in this order: headings, links, images, emphasis, code.
MARK_RULES = (
    ("(?Umd)^#{1,6}" + WS + "+", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
    ("`[^`]+`", ""),
)


# N14
def extract_text_content(markdown: Column) -> Column:
    """Markdown without marks. Links go before images, so ``![alt](x)`` leaves ``!alt``."""
    for pattern, replacement in MARK_RULES:
        markdown = F.regexp_replace(markdown, pattern, replacement)
    return collapse_ws(markdown)


# N15
def strip_code_fence(text: Column) -> Column:
    """Unwrap a text that was answered inside a code fence."""
    opened = F.regexp_replace(strip(text), r"\A```(?:markdown)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def url_host(url: Column) -> Column:
    """Authority part of an absolute URL, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """Path part, without query, fragment and the parameters of the last segment."""
    rest = F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?", "")
    return F.regexp_replace(F.regexp_extract(rest, "^[^?#]*", 0), r";[^/]*\z", "")


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper-cased, the rest lower-cased."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 2_000_000_000))), "")


# N16
def title_from_slug(url: Column) -> Column:
    """Title out of the last path segment; empty when the path has none."""
    last = F.regexp_extract(F.btrim(url_path(url), F.lit("/")), r"[^/]*\z", 0)
    return title_case(F.translate(F.regexp_replace(last, r"\.[^.]*\z", ""), "-_", "  "))


# N17
def inject_title(markdown: Column, page_title: Column, og_title: Column, url: Column) -> Column:
    """struct(markdown, title): a leading H1 is kept, else one is put in front.

    Empty titles count as missing. A title of blanks only does not, and gives an empty heading.
    """
    def given(x: Column) -> Column:
        return F.when(F.length(x) > 0, x)

    chosen = F.coalesce(given(og_title), given(page_title), given(title_from_slug(url)),
                        F.lit("Untitled Document"))

    def build(md: Column) -> Column:
        first = F.substring_index(strip(md), "\n", 1)
        return F.when(
            strip(md).startswith("# "),
            F.struct(md.alias("markdown"), strip(F.ltrim(first, F.lit("# "))).alias("title")),
        ).otherwise(let(collapse_ws(chosen), lambda t: F.struct(
            F.concat(F.lit("# "), t, F.lit("\n\n"), md).alias("markdown"), t.alias("title"))))

    return let(markdown, build)


# N18
def inject_section(markdown: Column, section: Column) -> Column:
    """Put a section behind the first line. The second line is dropped even when it is not blank."""
    def place(p: Column) -> Column:
        return F.when(
            F.size(p) >= 2,
            F.concat(p.getItem(0), F.lit("\n\n"), section, F.lit("\n\n"), F.coalesce(F.get(p, F.lit(2)), F.lit(""))),
        ).otherwise(F.concat(p.getItem(0), F.lit("\n\n"), section))

    return let(markdown, lambda md: F.when(
        F.length(section) > 0, let(F.split(md, "\n", 3), place)).otherwise(md))


# W1
def dedupe_consecutive_blocks(markdown: Column) -> Column:
    """Drop a block equal to the one just before it; later repeats stay.

    Blank lines at both ends are dropped; the blank lines behind a dropped block stay.
    """
    sep = f"{UNI}\n(?:{WS_NO_NL}*+\n)++"
    text = F.regexp_replace(markdown, rf"{UNI}\A(?:{WS_NO_NL}*+\n)++", "")
    text = F.regexp_replace(text, rf"{UNI}(?:\n{WS_NO_NL}*+)++\z", "")

    def fold(s: Column) -> Column:
        blocks, seps = s["b"], s["s"]

        def one(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(seps, i), F.lit(""))
            keep = (i == 0) | (x != F.get(blocks, i - 1))
            return F.when(keep, F.concat(x, after)).otherwise(F.substring(after, 2, 2_000_000_000))

        return F.array_join(F.transform(blocks, one), "")

    parts = let(text, lambda t: F.struct(F.split(t, sep).alias("b"),
                                         F.regexp_extract_all(t, F.lit(sep), F.lit(0)).alias("s")))
    return let(parts, fold)


# The removal rules of the cleaning chain, in their order (pattern, replacement).
_LINK_RULES = [
    (r"\[]\([^)]*\)", ""),
    (UNI + r"\[[^\]]+]\(" + WS + r"*\)", ""),
]
_IMAGES_OFF = (r"!\[[^\]]*\]\([^)]+\)", "")
_IMAGES_ON = (UNI + r"!\[([^\]]*)\]\(" + WS + r"*\)", "")
_BANG_RULES = [
    (UNI + "!" + WS + "+!", ""),
    (UNI + "!" + WS + "*\n", "\n"),
]
_LONE_BANG = ("(?md)^[ \t]*![ \t]*$", "")
_NOISE_RULES = [
    ("\n0:00\n", "\n"),
    ("\n/\n", "\n"),
    ("\nLIVE\n", "\n"),
    ("\n-0:00\n", "\n"),
    ("Video Player is loading\\.\n?", ""),
    ("(?s)To view this video please enable JavaScript.*?Play Video\n?", ""),
    ("(?s)Play\nMute\nCurrent Time.*?End of dialog window\\.\n?", ""),
    ("(?s)This is a modal window\\..*?Close Modal Dialog\n?", ""),
    ("(?s)Beginning of dialog window\\..*?End of dialog window\\.\n?", ""),
    ("No compatible source was found for this media\\.\n?", ""),
    ("\n[‹›]+\n", "\n"),
]


# Texts without which no noise rule can fire.
_NOISE_HINTS = ("\n0:00\n", "\n/\n", "\nLIVE\n", "\n-0:00\n", "Video Player is loading.", "To view this video please enable JavaScript",
                "Play\nMute\nCurrent Time", "This is a modal window.", "Beginning of dialog window.", "No compatible source was found",
                "‹", "›")


def _run(rules: list[tuple[str, str]], x: Column) -> Column:
    for pattern, replacement in rules:
        x = F.regexp_replace(x, pattern, replacement)
    return x


def _run_if(rules: list[tuple[str, str]], hints: tuple[str, ...], x: Column) -> Column:
    """The rules, skipped for texts that hold none of the hints: a plain search is far cheaper than a pattern."""
    return let(x, lambda t: F.when(
        reduce(lambda a, b: a | b, [F.contains(t, F.lit(h)) for h in hints]), _run(rules, t)).otherwise(t))


# N19
def regex_clean(markdown: Column, include_images: bool = True, strict: bool = False) -> Column:
    """The cleaning chain.

    The default keeps the chain's known side effects: an image without alt text loses
    its brackets first, and an exclamation mark at a line end goes with the blank line
    behind it. ``strict=True`` runs the image rule first and treats only a lone ``!``
    line as an artefact.
    """
    image = _IMAGES_ON if include_images else _IMAGES_OFF
    if strict:
        links, bangs = [image, (r"(?<!!)" + _LINK_RULES[0][0], ""), _LINK_RULES[1]], [_LONE_BANG]
    else:
        links, bangs = [*_LINK_RULES, image], _BANG_RULES
    x = _run_if(bangs, ("!",), _run_if(links, ("](",), markdown))
    return clean_markdown(dedupe_consecutive_blocks(_run_if(_NOISE_RULES, _NOISE_HINTS, x)))


# N20
def to_json_field(value: Column) -> Column:
    return F.to_json(value)


def from_json_field(text: Column, ddl: str) -> Column:
    """Parsed value, NULL when the text is not valid JSON of that shape."""
    return F.from_json(text, ddl)


# N21
def http_status_class(code: Column) -> Column:
    return (F.when(code.isNull() | (code == 0), F.lit("none"))
            .when(code >= 400, F.lit("error"))
            .when(code >= 300, F.lit("redirect"))
            .otherwise(F.lit("ok")))


# N22
def truncate_chars(text: Column, n: int) -> Column:
    """First n code points."""
    return F.substring(text, 1, n)


def _fold_table() -> tuple[str, str]:
    """Latin letters that are one base letter plus one mark, and that base letter."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x24F), (0x1E00, 0x1EFF)):
        for cp in range(lo, hi + 1):
            parts = unicodedata.normalize("NFD", chr(cp))
            if len(parts) == 2 and parts[0].isascii() and chr(cp) == chr(cp).lower():
                src.append(chr(cp))
                dst.append(parts[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()
TOKEN_CLASS = r"[\p{L}\p{N}]"
NON_TOKEN_CLASS = r"[^\p{L}\p{N}]"


def fold(text: Column) -> Column:
    """Lower-cased, with single diacritics of Latin letters removed. ASCII texts skip the table."""
    return let(text, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(
        F.translate(F.lower(x), FOLD_FROM, FOLD_TO)))


def fold_term(term: str) -> str:
    return term.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def search_tokens(text: Column) -> Column:
    """Search tokens: runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_CLASS + "+"), F.lit(0))
