import pytest

from webloam.operators import content as C
from webloam.plans.batch import run_batch, to_log_row
from webloam.plans.documents import process_pages
from webloam.schemas import PipelineConfig

HTML = """<html><head><title>Test Page</title></head><body><nav>Menu</nav><main><h1>Main Title</h1>
<p>This is the main content.</p></main><footer>Footer</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, fallback_markdown string, page_title string, og_title string"
URL = "https://example.com/test"


def docs(spark, rows, config=PipelineConfig(), responses=None):
    out = process_pages(spark.createDataFrame(rows, SCHEMA), config, responses).collect()
    return {r["page_id"]: r for r in out}


def test_page_chain(spark):
    got = docs(spark, [
        (1, URL, HTML, "# Fallback\n\nFallback.", "Test Page", None),
        (2, URL, "", "# Fallback Content\n\nFrom the crawl.", "Test Page", None),
        (3, URL, "<p>tiny</p>", "long " * 50, None, None),
        (4, "https://example.com/my-page.html", None, None, None, None),
        (5, URL, "<title>Own &amp; title</title><p>text</p>", "", None, None),
        (6, "https://arxiv.org/x", '<p class="abstract">' + "An abstract of more than fifty characters, surely so." + "</p><p>Body text.</p>", None, "T", None),
    ])
    assert got[1]["markdown"] == "# Main Title\n\nThis is the main content." and got[1]["title"] == "Main Title"
    assert got[1]["steps_applied"] == ["dom_pruning", "main_content", "title_injection", "regex_cleaning"]
    assert got[2]["markdown"] == "# Fallback Content\n\nFrom the crawl." and "fallback_empty" in got[2]["steps_applied"]
    assert "fallback_short" in got[3]["steps_applied"] and got[3]["markdown"].startswith("# Test\n\nlong long")
    assert (got[4]["markdown"], got[4]["title"]) == ("# My Page", "My Page")
    assert got[5]["markdown"] == "# Own & title\n\ntext"
    assert got[6]["markdown"] == "# T\n\n## Abstract\n\nAn abstract of more than fifty characters, surely so.\n\nBody text."
    assert got[6]["steps_applied"] == ["scientific_preprocess", "dom_pruning", "main_content", "title_injection", "scientific_inject", "regex_cleaning"]


def test_switches(spark):
    off = PipelineConfig(prune=False, extract=False, regex_clean=False)
    got = docs(spark, [(1, URL, HTML, "x\n\n\n\ny", None, None)], off)[1]
    assert got["markdown"] == "# Test Page\n\nx\n\n\n\ny" and got["steps_applied"] == ["fallback", "title_injection"]


def test_answers(spark):
    long_answer = "```markdown\n# Answer\n" + "good words " * 20 + "\n```"
    responses = spark.createDataFrame([
        (1, "html", long_answer), (2, "html", "too short"), (3, "html", ""), (1, "structure", "# Never used"),
        (2, "structure", "# Fixed\n\nMain Title This is the main content."), (3, "structure", "# T")],
        "page_id long, stage string, response string")
    got = docs(spark, [(i, URL, HTML, None, None, None) for i in (1, 2, 3)], responses=responses)
    assert got[1]["steps_applied"] == ["llm_html_sanitize", "title_injection", "regex_cleaning"]
    assert got[1]["markdown"] == "# Answer\n\n" + ("good words " * 20).strip()
    assert got[2]["steps_applied"][-1] == "llm_structure_sanitizer" and got[2]["markdown"].startswith("# Fixed")
    assert got[3]["steps_applied"] == ["dom_pruning", "main_content", "title_injection", "regex_cleaning"]
    assert got[3]["markdown"].startswith("# Main Title")


@pytest.mark.parametrize("md,expected", [
    ("# A\n# B\ntext\n### C\n#no\n##### D", "# A\n## B\ntext\n### C\n#no\n#### D"),
    ("### A\n# B\n# C", "## A\n# B\n## C"),
    ("no heading", "no heading"), ("", ""),
])
def test_headings(apply, md, expected):
    assert apply(C.normalize_headings, [md]) == [expected]


def test_many_headings(apply):
    text = "\n".join(f"{'#' * (i % 6 + 1)} h{i}" for i in range(1500))
    [got] = apply(C.normalize_headings, [text])
    assert [x.split(" ")[1] for x in got.split("\n")] == [f"h{i}" for i in range(1500)]
    levels = [len(x.split(" ")[0]) for x in got.split("\n")]
    assert levels[0] == 1 and levels.count(1) == 1 and all(b <= a + 1 for a, b in zip(levels, levels[1:]))


def test_residue_and_prompts(apply, spark):
    text = "Share\nDownload it\n Please wait \nLoading...\n- - -\nkeep [x]() ![](a) \x07end\n\nPDF"
    assert apply(C.strip_interface_residue, [text]) == ["Download it\nkeep   end\n"]
    df = spark.createDataFrame([(1, "a {{ b }}\n\n\n\nc")], "id int, markdown string")
    got = C.build_prompts(df, "x\n\n\n\ny {{ content }} z\n", "markdown").first()["prompt"]
    assert got == "x\n\ny a {{ b }}\n\n\n\nc z"
    assert C.build_prompts(df, "{{ content }}", "markdown", max_chars=3).first()["prompt"] == "a {"


def test_batch_keeps_going_when_items_fail(spark):
    pages = spark.createDataFrame(
        [(1, URL, HTML, None, 200, URL + "#r"), (2, URL + "2", None, "Timeout after 30000ms", None, None), (3, URL + "3", HTML, "HTTP 500", 500, None)],
        "page_id long, url string, html string, fetch_error string, http_status_code int, redirected_url string")
    meta = "meta struct<title:string,author:string,subject:string,creator:string,producer:string,creationDate:string,modDate:string>"
    pdfs = spark.createDataFrame(
        [(1, URL + ".pdf", 2, "second\x00", 10, ("T", None, "", None, None, "D:20240115", None)),
         (1, URL + ".pdf", 1, "first", 10, ("T", None, "", None, None, "D:20240115", None)),
         (2, URL + "big.pdf", 1, "x", 60 * 1024 * 1024, (None,) * 7)],
        "doc_id long, url string, page_num int, text string, file_size long, " + meta)
    whole = {r["url"]: r for r in run_batch(pages, pdfs).collect()}
    assert whole[URL + "big.pdf"]["success"] and whole[URL + "big.pdf"]["markdown"].endswith("## Page 1\n\nx")
    results = run_batch(pages, pdfs, PipelineConfig(max_pdf_mb=50))
    got = {r["url"]: r for r in results.collect()}
    assert got[URL]["success"] and got[URL]["content_type"] == "spa" and got[URL]["redirects"] == [URL + "#r"]
    assert got[URL]["pdf_metadata"] is None and got[URL]["extracted_title"] == "Main Title"
    assert got[URL + "2"]["error"].startswith("Timeout") and got[URL + "2"]["markdown"] == "" and got[URL + "2"]["content_type"] == "html"
    pdf = got[URL + ".pdf"]
    assert pdf["markdown"] == "# T\n\n**Pages:** 2\n**Creation date:** 2024-01-15T00:00:00\n\n---\n\n\n## Page 1\n\nfirst\n\n## Page 2\n\nsecond"
    assert (pdf["http_status_code"], pdf["pdf_metadata"]["pages"]) == (200, 2)
    assert got[URL + "big.pdf"]["error"] == "PDF too large: 60.0MB (max: 50MB)" and not got[URL + "big.pdf"]["success"]
    logs = {r["url"]: r for r in to_log_row(results).collect()}
    assert {u: r["status"] for u, r in logs.items()} == {
        URL: "success", URL + "2": "timeout", URL + "3": "error", URL + ".pdf": "success", URL + "big.pdf": "error"}
    assert logs[URL + "3"]["content_length"] == 0 and logs[URL]["js_executed"] is True
