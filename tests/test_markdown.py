"""Markdown structure of main texts, and character references."""

import html

import pytest

from webloam.functions import html as H

WORDS = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize(("page", "expected"), [
    (f"<p>{WORDS}</p><pre>def f(x):\n    return  x &lt; 2<br>\n\tend\n</pre><p>{WORDS} b</p>",
     f"{WORDS}\n\n```\ndef f(x):\n    return  x < 2\n\n\tend\n```\n\n{WORDS} b"),
    (f"<pre><code class=py>a = <b>1</b>\nb = 2</code></pre><p>{WORDS}</p>", f"```\na = 1\nb = 2\n```\n\n{WORDS}"),
    ("<ol><li>first</li><li>second</li></ol><ul><li>x</li></ul><ol><li>again</li></ol>", "1. first\n2. second\n- x\n1. again"),
    ("<ol><li>a<ol><li>inner</li><li>more</li></ol></li><li>b<ul><li>dot</li></ul></li><li>c</li></ol>", "1. a\n1. inner\n2. more\n2. b\n- dot\n3. c"),
    ("<ul><li>x</li><li>y</li></ul>", "- x\n- y"),
    ("<table><tr><th>N</th><th>V</th></tr><tr><td>a</td><td>1 | 2</td></tr><tr><td>b</td><td>3</td></tr></table><table><tr><td>q</td></tr></table>",
     "| N | V |\n| --- | --- |\n| a | 1 \\| 2 |\n| b | 3 |\n\n| q |\n| --- |"),
    ("<p>some <strong>bold </strong>and <em>slanted</em> text with <code>x = 1</code> and <b><i>both</i></b></p>",
     "some **bold** and *slanted* text with `x = 1` and ***both***"),
    ("<p>an <b>open one<p>never <i></i>closed</b> here", "an open one\n\nnever closed here"),
    (f"<blockquote><p>{WORDS}</p><p>said twice</p><blockquote>deeper</blockquote></blockquote><p>{WORDS} after</p>",
     f"> {WORDS}\n>\n> said twice\n>>\n>> deeper\n\n{WORDS} after"),
    (f"<blockquote><pre>x\ny</pre></blockquote><p>{WORDS}</p>", f"> ```\n> x\n> y\n> ```\n\n{WORDS}"),
    (f'<p><b>{WORDS} <a href="/q?a=1&copy=2&amp;b=3">link &copy 2020</a></b></p>', f"**{WORDS} [link © 2020](/q?a=1&copy=2&b=3)**"),
])
def test_structure_of_the_main_text(apply, page, expected):
    [got] = apply(lambda c: H.main_markdown(H.text_tokens(c)), [f"<html><body>{page}</body></html>"])
    assert got == expected


def test_numbers_count_over_many_items(apply):
    [got] = apply(lambda c: H.main_markdown(H.text_tokens(c)), ["<ol>" + "".join(f"<li>item {k}</li>" for k in range(1000)) + "</ol>"])
    assert got == "\n".join(f"{k + 1}. item {k}" for k in range(1000))


REFERENCES = ["&copy 2020", "&notin; &notit; &not", "&NotEqualTilde; &CounterClockwiseContourIntegral; &fjlig;", "&ampamp; &amp;amp;", "&lt&gt&quot", "AT&T &c &x; &",
              "&#169 &#xA9; &#xa9z &#150; &#x80;", "&Eacute&eacute; &bogus; &copyx;", "&nbsp;x", "&#38;lt;"]


def test_references_of_html_5(apply):
    assert apply(H.decode_entities, REFERENCES) == [html.unescape(x) for x in REFERENCES]


def test_references_in_attributes(apply):
    texts = ["?a=1&copy=2", "?a&copy2", "?a&copy;=2", "?a&copy", "&lt=", "&not;&notin;", "&amp;copy=1", "&ampx"]
    assert apply(lambda c: H.decode_entities(c, attribute=True), texts) == [
        "?a=1&copy=2", "?a&copy2", "?a©=2", "?a©", "&lt=", "¬∉", "&copy=1", "&ampx"]
