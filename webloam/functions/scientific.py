"""Abstracts, keywords and body sections of scientific pages, row by row.

Elements are taken in a fixed order and each one taken is removed from what the next
ones see, exactly as when a tree is edited in place: abstracts from the deepest to the
outermost, then keywords, then the article body.

Elements lie in document order, and each knows how many lie inside it, so what an element holds
is a slice. Removed elements are disjoint and in order, so removing them is one sweep over the page:
time grows with the page, however many elements are found in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloam.functions.html import attribute, decode_entities, elements, swept, tag_name
from webloam.functions.text import UNI, WS, let, strip

# Id parts of skipped sections, class and id parts of skipped paragraphs.
SKIPPED_SECTION_IDS = ("bibl", "coi", "ref")
SKIPPED_CLASSES = ("figure", "caption", "download")
SKIPPED_IDS = ("fig", "cap", "spar")
#: Characters that the text of an abstract or a paragraph must exceed, unless the caller says otherwise.
MIN_TEXT = 50
DEFAULT_ABSTRACT, DEFAULT_KEYWORDS = "Abstract", "Mots clés"
HEADINGS = ("h2", "h3", "h4")


def _get(xs: Column, i) -> Column:
    return F.get(xs, i if isinstance(i, Column) else F.lit(i))


def _with(x: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in names], *[v.alias(n) for n, v in more.items()])


_PLACE = ("s", "e", "depth")
_ELEMENT = (*_PLACE, "tag", "cls", "id")
_OWN = (*_ELEMENT, "k", "n")


def numbered(xs: Column, names: tuple[str, ...], size: Column, k: str, n: str) -> Column:
    """Elements in document order with their number ``k`` and how many others lie inside each, ``n``; ``size`` tokens in all."""
    def work(own: Column) -> Column:
        # for each token, how many elements have begun
        begun = F.flatten(F.transform(F.sequence(F.lit(0), F.size(own)), lambda i: F.array_repeat(
            i, (F.coalesce(_get(own, i)["s"], size) - F.coalesce(_get(own, i - 1)["s"], F.lit(0))).cast("int"))))
        return let(begun, lambda b: F.transform(own, lambda x, i: _with(x, names, **{
            k: i, n: _get(b, x["e"]) - i - 1})))

    return let(xs, work)


def levelled(xs: Column, names: tuple[str, ...]) -> Column:
    """Elements in document order with ``lvl``: how many others of them each lies in."""
    def step(open_: Column, x: Column) -> Column:
        return let(F.filter(open_, lambda e: e >= x["s"]), lambda left: F.struct(
            F.concat(F.array(x["e"]), left).alias("state"), F.array(F.size(left)).alias("out")))

    def work(own: Column) -> Column:
        levels = swept(own, F.array().cast("array<int>"), "array<int>", step)
        return let(levels, lambda found: F.transform(own, lambda x, i: _with(x, names, lvl=_get(found, i))))

    return let(xs, work)


def outermost(xs: Column, names: tuple[str, ...]) -> Column:
    return F.filter(levelled(xs, names), lambda x: x["lvl"] == 0)


def _parts(xs: Column, low: Column, high: Column, holes: Column, first, last, between=None) -> Column:
    """xs[low..high] without holes (disjoint, in order; hole h covers first(h)..last(h)), with ``between(h)`` in their places."""
    def part(i: Column) -> Column:
        hole = _get(holes, i)
        start = F.coalesce(last(_get(holes, i - 1)) + 1, low)
        stop = F.coalesce(first(hole) - 1, high)
        kept = F.slice(xs, (start + 1).cast("int"), F.greatest(stop - start + 1, F.lit(0)).cast("int"))
        return kept if between is None else F.when(hole.isNull(), kept).otherwise(F.concat(kept, between(hole)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(holes)), part))


def page_tree(tokens: Column) -> Column:
    """struct(toks, txt, els): tokens, their stripped text, and the elements with tag, class, id, number and count of inner ones."""
    def build(toks: Column) -> Column:
        def element(p: Column) -> Column:
            return let(_get(toks, p["s"]), lambda tok: _with(
                p, _PLACE, tag=tag_name(tok),
                cls=F.trim(F.regexp_replace(attribute(tok, "class"), UNI + WS + "+", " ")),
                id=attribute(tok, "id")))

        texts = F.transform(toks, lambda tok: F.when(
            tok.startswith("<") & (F.length(tok) > 1), F.lit("")).otherwise(strip(decode_entities(tok))))
        els = numbered(F.transform(elements(toks), element), _ELEMENT, F.size(toks), "k", "n")
        return F.struct(toks.alias("toks"), texts.alias("txt"), els.alias("els"))

    return let(tokens, build)


def _has(el: Column, part: str) -> Column:
    return F.contains(F.lower(el["cls"]), F.lit(part))


def _inner(els: Column, el: Column) -> Column:
    """Elements inside ``el``, itself excluded."""
    return F.slice(els, el["k"] + 2, el["n"])


def _joined(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), sep)


def _text(txt: Column, el: Column, sep: str) -> Column:
    """Text runs of an element, each stripped, joined by ``sep``."""
    return _joined(F.slice(txt, el["s"] + 1, el["e"] - el["s"] + 1), sep)


def cut_out(tree: Column, cuts: Column) -> Column:
    """The tree without the elements ``cuts`` (disjoint, in order): nothing is left of their tokens and of what they hold."""
    def work(x: Column) -> Column:
        tree, cuts = x["t"], x["c"]
        first, last = (lambda h: h["s"]), (lambda h: h["e"])
        top = F.size(tree["toks"]) - 1
        empty = lambda h: F.array_repeat(F.lit(""), h["e"] - h["s"] + 1)

        def dead(h: Column) -> Column:
            return F.transform(F.slice(tree["els"], h["k"] + 1, h["n"] + 1), lambda x: F.struct(
                *[x[n].alias(n) for n in _PLACE], *[F.lit("").alias(n) for n in ("tag", "cls", "id")], x["k"].alias("k"), x["n"].alias("n")))

        return F.when(F.size(cuts) == 0, tree).otherwise(F.struct(
            _parts(tree["toks"], F.lit(0), top, cuts, first, last, empty).alias("toks"),
            _parts(tree["txt"], F.lit(0), top, cuts, first, last, empty).alias("txt"),
            _parts(tree["els"], F.lit(0), F.size(tree["els"]) - 1, cuts, lambda h: h["k"], lambda h: h["k"] + h["n"], dead).alias("els")))

    return let(F.struct(tree.alias("t"), cuts.alias("c")), work)


def _result(out: Column, tree: Column) -> Column:
    return F.struct(out.alias("out"), tree.alias("tree"))


def abstracts(tree: Column, min_text: int = MIN_TEXT) -> Column:
    """struct(out, tree): one Markdown section per accepted abstract, and the tree without them.

    Abstracts of one level of nesting are disjoint; levels are taken from the deepest to the outermost.
    """
    is_abstract = lambda x: _has(x, "abstract") & ~_has(x, "content")

    def judge(t: Column, el: Column) -> Column:
        def parts(inner: Column) -> Column:
            heads = F.filter(inner, lambda x: x["tag"].isin(*HEADINGS))
            content = _get(F.filter(inner, lambda x: _has(x, "content")), 0)

            def text_of(hs: Column) -> Column:
                head = F.coalesce(_get(F.filter(hs, lambda x: x["depth"] == el["depth"] + 1), 0), _get(hs, 0))
                rest = let(outermost(hs, _PLACE), lambda holes: _parts(
                    t["txt"], el["s"], el["e"], holes, lambda h: h["s"], lambda h: h["e"]))
                return F.struct(
                    F.size(F.filter(inner, is_abstract)).alias("nested"),
                    let(head, lambda h: F.when(h.isNull(), F.lit("")).otherwise(_text(t["txt"], h, ""))).alias("head"),
                    let(content, lambda c: F.when(c.isNotNull(), _text(t["txt"], c, " ")).otherwise(_joined(rest, " "))).alias("text"))

            return let(heads, text_of)

        def accept(r: Column) -> Column:
            title = F.when(r["head"] != "", r["head"]).otherwise(F.lit(DEFAULT_ABSTRACT))
            return F.when((r["nested"] <= 1) & (F.length(r["text"]) > min_text), _with(
                el, (*_PLACE, "k", "n"), section=F.concat(F.lit("## "), title, F.lit("\n\n"), r["text"])))

        return let(let(_inner(t["els"], el), parts), accept)

    def work(t: Column) -> Column:
        def by_level(cands: Column) -> Column:
            def one(acc: Column, level: Column) -> Column:
                taken = F.filter(F.transform(F.filter(cands, lambda c: c["lvl"] == level), lambda c: judge(acc["tree"], c)), lambda x: x.isNotNull())
                return let(taken, lambda xs: F.struct(
                    F.concat(acc["out"], F.transform(xs, lambda x: F.struct(
                        (-x["depth"]).alias("up"), x["s"].alias("s"), x["section"].alias("section")))).alias("out"),
                    cut_out(acc["tree"], xs).alias("tree")))

            levels = F.sequence(F.array_max(F.transform(cands, lambda c: c["lvl"])), F.lit(0), F.lit(-1))
            start = F.struct(F.array().cast("array<struct<up:int,s:int,section:string>>").alias("out"), t.alias("tree"))
            found = F.aggregate(levels, start, one)
            return F.when(F.size(cands) == 0, _result(F.array().cast("array<string>"), t)).otherwise(let(found, lambda f: _result(
                F.transform(F.sort_array(f["out"]), lambda x: x["section"]), f["tree"])))

        return let(levelled(F.filter(t["els"], is_abstract), (*_PLACE, "k", "n")), by_level)

    return let(tree, work)


def keywords(tree: Column) -> Column:
    """struct(out, tree): one section per outermost keyword element; the elements are always removed."""
    def work(t: Column) -> Column:
        def section(el: Column) -> Column:
            inner = _inner(t["els"], el)
            head = _get(F.filter(inner, lambda x: x["tag"].isin(*HEADINGS)), 0)
            title = let(head, lambda h: F.when(h.isNull(), F.lit(DEFAULT_KEYWORDS)).otherwise(_text(t["txt"], h, "")))

            def named(name: Column) -> Column:
                marked = F.transform(F.filter(inner, lambda x: x["tag"].isin("span", "a") & _has(x, "keyword")), lambda x: _text(t["txt"], x, ""))
                listed = F.filter(marked, lambda k: (k != "") & (k != name))
                whole = F.btrim(F.replace(_text(t["txt"], el, ", "), name, F.lit("")), F.lit(", "))
                split = F.filter(F.transform(F.split(whole, ","), strip), lambda k: F.length(k) > 1)
                words = let(listed, lambda k: F.when(F.size(k) > 0, k).otherwise(split))
                return let(words, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("## "), name, F.lit("\n\n"), F.array_join(k, ", "))))

            return let(title, named)

        return let(outermost(F.filter(t["els"], lambda x: _has(x, "keyword")), (*_PLACE, "k", "n")), lambda own: _result(
            F.filter(F.transform(own, section), lambda x: x.isNotNull()), cut_out(t, own)))

    return let(tree, work)


def body_sections(tree: Column, min_text: int = MIN_TEXT) -> Column:
    """struct(out, tree): headed sections of the article body; the body is removed."""
    def work(t: Column) -> Column:
        txt, els = t["txt"], t["els"]
        by_id = F.filter(els, lambda x: x["id"] == "body")
        by_class = F.filter(els, lambda x: F.array_contains(F.split(x["cls"], " "), "Body"))
        body = F.coalesce(_get(by_id, 0), _get(by_class, 0))

        def sections_of(b: Column) -> Column:
            sections = numbered(levelled(F.filter(_inner(els, b), lambda x: x["tag"] == "section"), _OWN), (*_OWN, "lvl"), F.size(txt), "j", "m")

            def each(all_: Column) -> Column:
                def one(sec: Column) -> Column:
                    # what lies in this section but in no section inside it
                    nested = F.filter(F.slice(all_, sec["j"] + 2, sec["m"]), lambda x: x["lvl"] == sec["lvl"] + 1)
                    own = let(nested, lambda holes: _parts(
                        els, sec["k"] + 1, sec["k"] + sec["n"], holes, lambda h: h["k"], lambda h: h["k"] + h["n"]))

                    def section(own: Column) -> Column:
                        head = _get(F.filter(own, lambda x: x["tag"].isin("h2", "h3") & (x["depth"] == sec["depth"] + 1)), 0)
                        texts = F.filter(own, lambda x: x["tag"].isin("div", "p") & ~F.lower(x["cls"]).rlike("|".join(SKIPPED_CLASSES))
                                         & ~x["id"].rlike("|".join(SKIPPED_IDS)))
                        paragraphs = F.array_distinct(F.filter(
                            F.transform(texts, lambda x: _text(txt, x, " ")), lambda x: F.length(x) > min_text))
                        title = let(head, lambda h: F.when(h.isNull(), F.lit("")).otherwise(_text(txt, h, "")))
                        return let(F.struct(title.alias("h"), paragraphs.alias("p")), lambda r: F.when(
                            (r["h"] != "") & (F.size(r["p"]) > 0),
                            F.concat(F.lit("## "), r["h"], F.lit("\n\n"), F.array_join(r["p"], "\n\n"))))

                    return F.when(~sec["id"].rlike("|".join(SKIPPED_SECTION_IDS)), let(own, section))

                return F.filter(F.transform(all_, one), lambda x: x.isNotNull())

            return F.when(b.isNull(), _result(F.array().cast("array<string>"), t)).otherwise(
                _result(let(sections, each), cut_out(t, F.array(b))))

        return let(body, sections_of)

    return let(tree, work)
