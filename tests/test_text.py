import hashlib
import random
import re

import pytest

from webloam.functions import text as X


def paragraphs(rnd):
    """Paragraphs with repeats next to each other and further apart, and the text that is left when neighbours are told once."""
    pool = [f"alpha {k}\nsecond line {k}" if k % 2 else f"beta {k}" for k in range(4)]
    said = [rnd.choice(pool) for _ in range(rnd.randint(1, 9))]
    left = [p for k, p in enumerate(said) if not k or p != said[k - 1]]
    return said, left


def random_texts(n, alphabet, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


def test_neighbouring_repeats_are_told_once(apply):
    rnd = random.Random(1)
    told = [paragraphs(rnd) for _ in range(400)]
    gaps = ["\n\n", "\n\n\n", "\n\n\n\n\n"]
    texts = ["".join(x for p in said for x in (p, rnd.choice(gaps))) for said, _ in told]
    clean = lambda c: X.clean_markdown(X.dedupe_consecutive_blocks(c))
    got = apply(clean, texts)
    assert got == ["\n\n".join(left) for _, left in told]
    assert apply(clean, got) == got


def test_any_blanks_leave_at_most_one_empty_line(apply):
    texts = random_texts(2000, ["a", "b", "\n", "\n", "\n\n", " ", "\t", "\xa0"], 1)
    got = apply(lambda c: X.clean_markdown(X.dedupe_consecutive_blocks(c)), texts)
    assert not any("\n\n\n" in t or t != t.strip() for t in got)
    letters = lambda t: [c for c in t if c in "ab"]
    assert all(len(letters(g)) <= len(letters(t)) for g, t in zip(got, texts))


def test_headings_stand_between_empty_lines(apply):
    rnd = random.Random(2)
    texts, expected = [], []
    for _ in range(500):
        lines = [rnd.choice(["plain", "more text", "# top", "## under"]) for _ in range(rnd.randint(1, 8))]
        texts.append("\n".join(lines))
        parts, open_ = [], []
        for line in lines:  # runs of plain lines and single headings, an empty line between any two of them
            if line.startswith("#"):
                parts += (["\n".join(open_)] if open_ else []) + [line]
                open_ = []
            else:
                open_.append(line)
        expected.append("\n\n".join(parts + (["\n".join(open_)] if open_ else [])))
    got = apply(X.normalize_markdown_spacing, texts)
    assert got == expected and apply(X.normalize_markdown_spacing, got) == got


def test_strip_and_collapse_follow_python(apply):
    texts = random_texts(1500, ["a", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "​"], 3)
    assert apply(X.strip, texts) == [t.strip() for t in texts]
    assert apply(X.collapse_ws, texts) == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_plain_text_keeps_words_and_drops_marks(apply):
    rnd = random.Random(4)
    forms = {"{0}": "{0}", "# {0}\n": "{0}", "### {0}\n": "{0}", "[{0}](https://site.example/{0})": "{0}", "**{0}**": "{0}", "_{0}_": "{0}", "`{0}`": ""}
    texts, expected = [], []
    for _ in range(600):
        chosen = [(rnd.choice(list(forms)), f"word{rnd.randint(0, 99)}") for _ in range(rnd.randint(1, 7))]
        texts.append("\n".join(form.format(w) for form, w in chosen))
        expected.append(" ".join(x for x in (forms[form].format(w) for form, w in chosen) if x))
    assert apply(X.extract_text_content, texts) == expected


def test_title_case_follows_python(apply):
    texts = ["my awesome page", "l'art 3d my-page été", "ABC dEF", "x1y z", ""]
    assert apply(X.title_case, texts) == [t.title() for t in texts]


@pytest.mark.parametrize("url,title", [
    ("https://site.example/green-tea_and-cake.html", "Green Tea And Cake"),
    ("https://site.example/a/b_c.tar.gz?x=/y#z", "B C.Tar"),
    ("https://site.example/", ""), ("https://site.example", ""), ("https://site.example/a/", "A"),
    ("/just/path-here", "Path Here"), ("https://e.com/x;v=1", "X"),
])
def test_slug_titles(apply, url, title):
    assert apply(X.title_from_slug, [url]) == [title]


@pytest.mark.parametrize("md,page,og,url,markdown,title", [
    ("# Tea\n\nLeaves", "Cups", "Pots", "https://e.com/p", "# Tea\n\nLeaves", "Tea"),
    ("Leaves", "Cups", "Pots", "https://e.com/p", "# Pots\n\nLeaves", "Pots"),
    ("Leaves", "Cups", None, "https://e.com/p", "# Cups\n\nLeaves", "Cups"),
    ("Leaves", "", "", "https://e.com/tea-leaves.html", "# Tea Leaves\n\nLeaves", "Tea Leaves"),
    ("Content", None, None, "https://e.com/", "# Untitled Document\n\nContent", "Untitled Document"),
    ("Content", " \t ", None, "https://e.com/x", "# \n\nContent", ""),
    ("\n # T # \nx", None, None, "u", "\n # T # \nx", "T #"),
    ("", None, " a \n b ", "u", "# a b\n\n", "a b"),
])
def test_title_injection(apply, md, page, og, url, markdown, title):
    [got] = apply(X.inject_title, [md], [page], [og], [url])
    assert (got["markdown"], got["title"]) == (markdown, title)


@pytest.mark.parametrize("md,expected", [
    ("tea [](https://site.example/x) cake", "tea  cake"),
    ("tea\n\n\n\n\n\ncake", "tea\n\ncake"),
    ("tea ![pot]() cake", "tea ! cake"),
    ("tea ! ! cake", "tea  cake"),
    ("tea\n0:00\n/\nLIVE\n-0:00\ncake", "tea\ncake"),
    ("a\n0:00\n0:00\nb", "a\n0:00\nb"),
    ("tea\nhot\n\ntea\nhot\n\ncake", "tea\nhot\n\ncake"),
    ("tea\n\ncake\n\ntea", "tea\n\ncake\n\ntea"),
    ("Tea!\n\nCake", "Tea\nCake"),
    ("x ![](a.png) y", "x ! y"),
    ("x\n‹››\ny", "x\ny"),
    ("p To view this video please enable JavaScript, now\nx Play Video\nq", "p q"),
])
def test_cleaning_rules(apply, md, expected):
    assert apply(X.regex_clean, [md]) == [expected]


def test_strict_cleaning_and_images_off(apply):
    assert apply(lambda c: X.regex_clean(c, strict=True), ["Hello!\n\nWorld", "a ![alt]() b", "a\n!\nb"]) == [
        "Hello!\n\nWorld", "a  b", "a\n\nb"]
    assert apply(lambda c: X.regex_clean(c, include_images=False), ["a ![x](y.png) b"]) == ["a  b"]


def test_long_texts_do_not_overflow_the_stack(apply):
    texts = ["line\n" * 30_000, "\n" * 100_000, " \n" * 50_000 + "x", "word " * 100_000]
    got = apply(X.regex_clean, texts)
    assert [len(t) for t in got] == [len(texts[0]) - 1, 0, 1, len(texts[3]) - 1]


def test_small_functions(apply):
    assert apply(X.clean_markdown, ["# Tea\n\n\n\nleaves\n\n\n\n\nwater", "hot\n   \ncold"]) == [
        "# Tea\n\nleaves\n\nwater", "hot\n\ncold"]
    assert apply(X.parse_pdf_date, ["D:20240115103000+01'00'", "D:20240115", "D:202401151030", "Jan 2024", "", None]) == [
        "2024-01-15T10:30:00", "2024-01-15T00:00:00", "2024-01-15T10:30:00", "Jan 2024", None, None]
    assert apply(X.clean_pdf_text, [" a\x00b\t  c\n\n\n\nd\x0b "]) == ["ab c\n\nd"]
    assert apply(X.strip_code_fence, ["```markdown\n# A\n```", "```\nx```", " plain ", "```"]) == ["# A", "x", "plain", ""]
    assert apply(X.content_hash, ["é", "", None]) == [hashlib.sha256("é".encode()).hexdigest(), None, None]
    assert apply(X.content_length, ["é😀", None]) == [2, 0]
    assert apply(X.inject_section, ["t\ndropped\nrest\nmore", "one", "a\nb", "a\nb"], ["S", "S", "S", ""]) == [
        "t\n\nS\n\nrest\nmore", "one\n\nS", "a\n\nS\n\n", "a\nb"]
    assert apply(X.search_tokens, ["L'Été: 3D-ßx à la_carte"]) == [["l", "ete", "3d", "ßx", "a", "la", "carte"]]
