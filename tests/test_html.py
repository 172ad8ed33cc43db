import pytest
from pyspark.sql import functions as F

from webloam.functions import html as H
from webloam.operators import pages as D


def pruned(c):
    return H.tokens_html(D.pruned_tokens(H.html_tokens(c)))


@pytest.mark.parametrize("html,expected", [
    ('<section><p>tide tables</p><nav class=x><ul><li><a href="/t">tides</a></ul></nav>of March</section>', "<section><p>tide tables</p>of March</section>"),
    ("<article>harbour<footer><p>office hours</footer></article>quay", "<article>harbour</article>quay"),
    ('<p>one<script type="text/x">if (a < b) { w("<p>two</p>") }</script> three</p>', "<p>one three</p>"),
    ('<ul><li>oak</li><li class="top newsletter-box">sign up</li><li>elm</li></ul>', "<ul><li>oak</li><li>elm</li></ul>"),
    ('<div id=SideBar>a<div>b</div>c</div>d', "d"),
    ('<head><title>x</title></head><header>h</header>y', "<head><title>x</title></head>y"),
    ('<div class="ad">kept</div>', '<div class="ad">kept</div>'),
    ('<div title="a > share" class="x">kept</div>', '<div title="a > share" class="x">kept</div>'),
    ('<nav>a<nav>b</nav>c</nav>d', "d"),
    ('<p class=share>gone<p>kept', "<p>kept"),
    ('<ul><li class="social">gone<li>kept</ul>', "<ul><li>kept</ul>"),
    ('<div><span class=popup>open <b>x</div>kept', "<div></div>kept"),
    ('<div><nav>open<ul><li>x</ul></div>kept', "<div></div>kept"),
    ('<img class=banner src=x>kept<br/>', "kept<br/>"),
    ('<!-- <nav> -->a<!-- open', "<!-- <nav> -->a<!-- open"),
    ('<script>never closed <p>x', ""),
    ('a < b <p data-id="share">x</p>', 'a < b <p data-id="share">x</p>'),
    ("", ""), (None, ""),
])
def test_pruning(apply, html, expected):
    assert apply(pruned, [html]) == [expected]


def test_tokens_join_back_to_the_html(apply):
    htmls = ["<a href='x>y'>t</a>", "<<>>", "a<b", "<p", "<!doctype html><p class=>x</P>", '<div class="a"">x</div><i a="b>', "&amp;<"]
    assert apply(lambda c: H.tokens_html(H.html_tokens(c)), htmls) == htmls


def test_elements_have_implied_ends(apply):
    [got] = apply(lambda c: H.elements(H.html_tokens(c)), ["<ul><li>1<li>2<ul><li>x</ul></ul><p>a<b>b<p>c</p></i>"])
    assert [(e["s"], e["e"], e["depth"]) for e in got] == [
        (0, 9, 1), (1, 2, 2), (3, 8, 2), (5, 8, 3), (6, 7, 4), (10, 13, 1), (12, 13, 2), (14, 16, 1)]


def test_deep_and_wide_pages(apply):
    wide = "<div>" + '<p class="share">x</p><p>y</p>' * 3000 + "</div>"
    deep = "<div>" * 400 + "t" + "</div>" * 400
    got = apply(pruned, [wide, deep])
    assert got == ["<div>" + "<p>y</p>" * 3000 + "</div>", deep]


@pytest.mark.parametrize("html,expected", [
    ("<body><h2>T</h2><p>a <b>b</b>\n c</p></body>", "## T\n\na **b** c"),
    ('<p>see <a href="/q?a=1&amp;b"> the  link </a> here now</p>', "see [ the link ](/q?a=1&b) here now"),
    ("<ul><li>one<li>two</ul>x", "- one\n- two\n\nx"),
    ("<table><tr><th>a<th>b</tr><tr><td>1</td><td><p>2</p></td></tr></table><p>z</p>", "| a | b |\n| --- | --- |\n| 1 | 2 |\n\nz"),
    ('<p><img src="a.png" alt="A"></p>', "![A](a.png)"),
    ("<head><title>no</title></head><body>yes</body>", "yes"),
    ("<title>no</title>yes", "yes"),
    ("&eacute;&#233;&#xE9;&#x1F600;&amp;lt;&bogus;&#0;", "éééé😀&lt;&bogus;�".replace("éééé", "ééé")),
    ('<p><a href="x">only links here</a></p><p>words</p>', "words"),
    ("<p> </p>", None), ("", None),
])
def test_main_text(apply, html, expected):
    assert apply(lambda c: H.main_markdown(H.html_tokens(c)), [html]) == [expected]


def test_link_rich_block_between_plain_ones_is_kept(apply):
    html = '<p>plain one</p><p>abc <a href="u">defgh</a></p><p>plain two</p><p>abc <a href="u">defgh</a></p>'
    assert apply(lambda c: H.main_markdown(H.html_tokens(c)), [html]) == ["plain one\n\nabc [defgh](u)\n\nplain two"]


def test_whole_page_drops_short_blocks(apply):
    html = "<nav>menu</nav><h1>T</h1><p>" + "w " * 10 + "</p><p>" + "w " * 9 + "</p>"
    assert apply(lambda c: H.whole_page_markdown(H.html_tokens(c)), [html]) == ["# T\n\n" + " ".join("w" * 10)]


def test_titles_links_and_scrubbing(spark):
    html = ('<head><!-- <title>no</title> --><title> A &amp; B </title><meta content="OG" property="og:title"><link rel=x></head>'
            '<p style="x" data-a=\'1\' id=k>t<svg><path/></svg></p><a href="/in">i</a><a href="//e.com/x">i</a><a href="http://o.com">o</a><a name=n>x</a><img>')
    df = spark.createDataFrame([(1, "http://e.com/p", html)], "page_id long, url string, html string")
    assert D.page_titles(df).first()[1:] == ("A & B", "OG")
    assert D.link_image_counts(df).first()[1:] == (2, 1, 3, 1)
    scrubbed = D.scrub_html_for_prompt(df).first()["html"]
    assert "<p id=k>t</p>" in scrubbed and "meta" not in scrubbed and "svg" not in scrubbed and "<link" not in scrubbed


def test_class_lookup(apply):
    toks = ['<div class="Abstract Author">', "<div class=abstract>", "<div id=abstract>", "abstract", "</div>"]
    assert apply(lambda c: H.has_class_containing(c, "abstract"), toks) == [True, True, False, False, False]


def test_token_table(spark):
    df = spark.createDataFrame([(7, "<p>a<br>b</p>")], "page_id long, html string")
    rows = [tuple(r) for r in D.tokenize_html(df).orderBy("pos").collect()]
    assert rows == [(7, 0, "<p>", "p", 1, 4, 1), (7, 1, "a", "", 0, None, None), (7, 2, "<br>", "br", 0, 2, 2),
                    (7, 3, "b", "", 0, None, None), (7, 4, "</p>", "p", -1, None, None)]


def test_no_exchange_in_the_page_operators(spark):
    df = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>x</p>").alias("html"))
    for op in (D.prune_dom, D.extract_main_content, D.tokenize_html, D.link_image_counts):
        assert "Exchange" not in op(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("unit", ["<a", '<a href="', "<!x", "</b", "<a b=c", "<script", "<!--"])
def test_tags_that_never_end_take_linear_time(apply, unit):
    import time

    def seconds(n):
        start = time.perf_counter()
        [got] = apply(lambda c: F.array_join(H.html_tokens(c), ""), ["<p>x</p>" + unit * n])
        assert got.startswith("<p>x</p>")
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 30  # quadratic work would take minutes
