import time

import pytest

from webloam.operators.scientific import extract_abstracts, extract_body_sections, extract_keywords, reinject_sections, scientific_preprocess
from webloam.functions.outcome import is_scientific_site

LONG = "This sentence is certainly longer than fifty characters in all."


def run(spark, html, url="https://arxiv.org/abs/1"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    row = scientific_preprocess(df).first()
    return row["html"], row["scientific_content"]


def test_hosts(apply):
    urls = ["https://www.sciencedirect.com/article/123", "https://link.springer.com/article/123", "https://www.nature.com/articles/123",
            "https://pubmed.ncbi.nlm.nih.gov/123", "https://example.com/article", "https://blog.example.org/post", "arxiv.org/x", None]
    assert apply(is_scientific_site, urls) == [True, True, True, True, False, False, False, False]


def test_abstract_with_heading(spark):
    html = ('<div class="abstract author"><h2>Résumé</h2><div class="abstract-content"><p>Ceci est le contenu du résumé qui doit être '
            'extrait correctement.</p></div></div><p>rest</p>')
    assert run(spark, html) == ("<p>rest</p>", "## Résumé\n\nCeci est le contenu du résumé qui doit être extrait correctement.")


def test_container_of_two_abstracts_is_no_abstract(spark):
    html = (f'<div class="abstracts"><div class="abstract"><h2>A</h2><p>{LONG}</p></div><div class="abstract"><h3>B</h3>'
            f'<p>{LONG} Two.</p></div></div>')
    left, content = run(spark, html)
    assert content == f"## A\n\n{LONG}\n\n## B\n\n{LONG} Two." and left == '<div class="abstracts"></div>'


def test_deeper_nesting_is_judged_on_what_is_left(spark):
    html = f'<div class="abstract"><h2>Outer</h2>{LONG} Outer.<div class="abstract"><h4>Inner</h4><b>{LONG}</b></div></div>'
    assert run(spark, html) == ("", f"## Inner\n\n{LONG}\n\n## Outer\n\n{LONG} Outer.")


def test_short_abstract_stays_and_has_default_title(spark):
    assert run(spark, '<div class="abstract">short</div>') == ('<div class="abstract">short</div>', "")
    assert run(spark, f'<p class="abstract">{LONG}</p>')[1] == f"## Abstract\n\n{LONG}"


def test_keywords(spark):
    html = ('<div class="keywords"><h2>Mots clés</h2><span class="keyword">Papillomavirus</span><span class="keyword">Vaccination</span></div>'
            '<div class="keyword-list">alpha, beta , c</div>')
    assert run(spark, html) == ("", "## Mots clés\n\nPapillomavirus, Vaccination\n\n## Mots clés\n\nalpha, beta")


def test_body_sections(spark):
    paragraphs = "".join(f"<p>{LONG} {i}</p>" for i in range(7))
    html = (f'<div class="Body"><section id="preface"><h2>Skipped</h2><p>{LONG}</p></section><section><h2>Intro</h2>{paragraphs}<p>{LONG} 0</p>'
            f'<div class="Figure-x">{LONG} fig</div><p id="spar1">{LONG} spar</p><section><h3>Sub</h3><p>{LONG} sub</p></section></section>'
            f'<section><p>{LONG} no heading</p></section></div>tail')
    left, content = run(spark, html)
    intro = "\n\n".join(f"{LONG} {i}" for i in range(7))
    assert (left, content) == ("tail", f"## Intro\n\n{intro}\n\n## Sub\n\n{LONG} sub")


def test_other_hosts_are_left_alone(spark):
    html = f'<p class="abstract">{LONG}</p>'
    assert run(spark, html, "https://example.com/") == (html, "")


def test_rows_and_reinjection(spark):
    df = spark.createDataFrame([(1, f'<p class="abstract">{LONG}</p><i class=keyword>k1, k2</i>')], "page_id long, html string")
    assert [tuple(r) for r in extract_abstracts(df).collect()] == [(1, 0, f"## Abstract\n\n{LONG}")]
    assert [tuple(r) for r in extract_keywords(df).collect()] == [(1, 0, "## Mots clés\n\nk1, k2")]
    docs = spark.createDataFrame([(1, "# T\n\nbody"), (2, "# U\n\nbody")], "page_id long, markdown string")
    sections = spark.createDataFrame([(1, "S")], "page_id long, scientific_content string")
    assert {r[0]: r[1] for r in reinject_sections(docs, sections).collect()} == {1: "# T\n\nS\n\nbody", 2: "# U\n\nbody"}


def test_nested_sections_keep_what_is_theirs(spark):
    html = (f'<article id="body"><section><h2>A</h2><p>{LONG} a</p><div><section><h3>B</h3><p>{LONG} b</p><section><h2>C</h2><p>{LONG} c</p></section>'
            f'<p>{LONG} b2</p></section></div><p>{LONG} a2</p></section><section id="references"><h2>R</h2><p>{LONG} r</p></section></article>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [r.section for r in extract_body_sections(df).orderBy("ordinal").collect()]
    inner = f"B {LONG} b C {LONG} c {LONG} b2"
    assert got == [f"## A\n\n{LONG} a\n\n{inner}\n\n{LONG} a2", f"## B\n\n{LONG} b\n\n{LONG} b2", f"## C\n\n{LONG} c"]


def test_abstracts_inside_abstracts(spark):
    deep = f'<div class="abstract"><h3>1</h3>{LONG} 1</div>'
    for k in (2, 3, 4):
        deep = f'<div class="abstract"><h3>{k}</h3>{LONG} {k}{deep}</div>'
    two = f'<div class="abstract">short<div class="abstract">s</div></div><div class="abstract">{LONG} w<i class="abstract">x</i><i class="abstract">y</i></div>'
    left, content = run(spark, deep + two)
    assert content == "\n\n".join(f"## {k}\n\n{LONG} {k}" for k in (1, 2, 3, 4)) and left == two


def test_texts_may_be_shorter_where_the_caller_says_so(spark):
    df = spark.createDataFrame([(1, '<p class="abstract">a few words</p><div id="body"><section><h2>H</h2><p>tiny</p></section></div>')], "page_id long, html string")
    assert extract_abstracts(df).count() == 0 and [r.section for r in extract_abstracts(df, min_text=5).collect()] == ["## Abstract\n\na few words"]
    assert [r.section for r in extract_body_sections(df, min_text=3).collect()] == ["## H\n\ntiny"]


@pytest.mark.parametrize("kind", ["spans", "in_one", "sections", "abstracts"])
def test_many_elements_take_linear_time(spark, kind):
    def page(n):
        if kind == "spans":
            return "".join(f'<span class="keyword">k{i}</span>' for i in range(n)), n
        if kind == "in_one":
            return '<div class="keywords">' + "".join(f'<span class="keyword">k{i}</span>' for i in range(n)) + "</div>", 1
        if kind == "sections":
            return '<div id="body">' + "".join(f"<section><h2>S{i}</h2><p>{LONG} {i}</p></section>" for i in range(n)) + "</div>", n
        return "".join(f'<div class="abstract"><h2>A{i}</h2><p>{LONG} {i}</p></div>' for i in range(n)), n

    times = []
    for n in (500, 1_000, 8_000):
        html, sections = page(n)
        start = time.perf_counter()
        left, content = run(spark, html)
        times.append(time.perf_counter() - start)
        assert left == "" and content.count("## ") == sections
    assert times[2] < 12 * times[1] + 4
