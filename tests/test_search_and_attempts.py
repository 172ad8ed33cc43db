import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from webloam.functions import outcome as OC
from webloam.operators import search as J
from webloam.operators.attempts import resolve_attempts
from webloam.sources import logs as L

WORDS = ["café", "cafe", "the", "The", "thé", "theme", "of", "x1", "naïve", "été"]


def fold(word):
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def tokens(text):
    return [fold(w) for w in re.findall(r"[^\W_]+", text)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    texts = {str(i): " -\n,_"[i % 5].join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))) for i in range(300)}
    rows = [(k, f"https://e.com/{WORDS[int(k) % 10]}", v, "success") for k, v in texts.items()]
    df = spark.createDataFrame(rows, "id string, url string, markdown_content string, status string").cache()
    return df, {r[0]: (tokens(r[1]), tokens(r[2])) for r in rows}


def has(seq, words, prefix=False):
    n = len(words)
    for i in range(len(seq) - n + 1):
        part = seq[i:i + n]
        if part == words or (prefix and part[:-1] == words[:-1] and part[-1].startswith(words[-1])):
            return True
    return False


@pytest.mark.parametrize("terms", [
    J.Terms(all_of=("CAFE", "the")), J.Terms(any_of=("x1", "naive")), J.Terms(all_of=("of",), none_of=("ete",)),
    J.Terms(phrase="the of"), J.Terms(prefix="the"), J.Terms(all_of=("théme",), field="url"), J.Terms(phrase="of the", field="markdown"),
    J.Terms(all_of=("of the",), any_of=("cafe x1", "été")), J.Terms(all_of=("...",)),
    J.Terms(any_of=("...", "cafe")), J.Terms(any_of=("...",)), J.Terms(prefix="of th"), J.Terms(prefix="the of x"), J.Terms(prefix="..."), J.Terms(),
    J.Terms(prefix="naiv", any_of=("of", "the of")), J.Terms(phrase="..."),
])
def test_search_matches_brute_force(corpus, terms):
    df, facts = corpus

    def found(seqs, text, prefix=False):
        words = tokens(text)
        return bool(words) and any(has(s, words, prefix) for s in seqs)

    expected = set()
    for key, (url, body) in facts.items():
        seqs = {"url": [url], "markdown": [body]}.get(terms.field, [url, body])
        ok = all(found(seqs, t) for t in terms.all_of) and not any(found(seqs, t) for t in terms.none_of)
        ok = ok and (not terms.any_of or any(found(seqs, t) for t in terms.any_of))
        ok = ok and (not terms.phrase or found(seqs, terms.phrase)) and (not terms.prefix or found(seqs, terms.prefix, True))
        if ok:
            expected.add(key)
    assert {r["id"] for r in J.search_logs(df, terms).collect()} == expected
    if not terms.none_of:
        got = J.search_with_postings(df, J.build_postings(df), terms)
        assert {r["id"] for r in got.collect()} == expected


def test_postings_sort_words_without_an_interpreted_comparison(spark):
    logs = spark.createDataFrame([("1", "https://b.a/c", "b a b Á c"), ("2", None, None), (None, "", "x x")], "id string, url string, markdown_content string")
    postings = J.build_postings(logs)
    found = {(r["field"], r["term"], r["id"], tuple(r["positions"])) for r in postings.filter("field = 'markdown'").collect()}
    assert found == {("markdown", "a", "1", (1, 3)), ("markdown", "b", "1", (0, 2)), ("markdown", "c", "1", (4,)), ("markdown", "x", None, (0, 1))}
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_postings_follow_the_table(spark, corpus, tmp_path):
    df, _ = corpus
    logs_path, postings_path = str(tmp_path / "logs"), str(tmp_path / "postings")
    stamped = df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id").cast("int") % 3 * 86400))
    L.append_logs(stamped, logs_path)
    keep_equal = J.maintain_postings(logs_path, postings_path)

    def check():
        built = J.build_postings(L.read_log_files(spark, logs_path))
        stored = spark.read.parquet(postings_path).select(*built.columns)
        assert sorted(map(repr, stored.collect())) == sorted(map(repr, built.collect()))

    everything = L.read_log_files(spark, logs_path)
    keep_equal(everything, 0)
    check()
    days = sorted(L.days_of(spark, logs_path))
    L.delete_log_at(spark, logs_path, "4")
    touched = everything.select("log_date").filter(F.col("log_date") != days[2])
    batch = spark.createDataFrame([(d,) for d in days[:2]], "log_date date")
    L.drop_day(spark, logs_path, days[0])
    del touched
    keep_equal(batch, 1)
    check()
    keep_equal(batch, 1)
    check()


def test_crash_and_retry_classes(apply):
    errors = ["Browser has been closed", "Target closed unexpectedly", "Connection refused to browser", "Protocol error in playwright",
              "Page crashed during navigation", "playwright._impl._errors.Error", "Page not found (404)", "Network timeout", "DNS resolution failed", None]
    assert apply(OC.is_browser_crash, errors) == [True] * 6 + [False] * 4
    kinds = ["html", "pdf", "html", "pdf"]
    assert apply(OC.is_retryable, ["Temporary failure", "Temporary failure", "CONNECTION reset", "Network down"], kinds) == [True, False, True, True]
    assert apply(OC.is_pdf_url, ["https://e.com/A.PDF", "https://e.com/a.pdf//", "https://e.com/a.pdf?x=1"]) == [True, True, False]
    assert apply(OC.detect_kind, ["application/pdf", "text/html", None, "text/html"], ["u", "u.pdf", "u", "u"]) == ["pdf", "pdf", "html", "html"]


def test_attempts(spark):
    crash = "Browser has been closed"
    rows = [
        ("two timeouts", 1, False, "timeout", "html", None), ("two timeouts", 2, False, "timeout", "html", None), ("two timeouts", 3, True, None, "html", None),
        ("not found", 1, False, "404", "html", None), ("not found", 2, True, None, "html", None),
        ("restarted", 1, False, crash, "html", True), ("restarted", 2, True, None, "html", None),
        ("lost", 1, False, "timeout", "html", None), ("lost", 2, False, crash, "html", False), ("lost", 3, True, None, "html", None),
        ("exhausted", 1, False, "timeout a", "html", None), ("exhausted", 2, False, "network b", "html", None),
        ("exhausted", 3, False, "temporary c", "html", None), ("exhausted", 4, True, None, "html", None),
        ("pdf", 1, False, "temporary", "pdf", None), ("pdf", 2, True, None, "pdf", None),
        ("cut", 1, False, "timeout", "html", None),
    ]
    df = spark.createDataFrame(rows, "url string, attempt int, success boolean, error string, kind string, restarted boolean")
    got = {r["url"]: tuple(r)[1:] for r in resolve_attempts(df).collect()}
    assert got == {
        "two timeouts": (True, None, 3, 2), "not found": (False, "404", 1, 0), "restarted": (True, None, 2, 1),
        "lost": (False, crash, 2, 0), "exhausted": (False, "Failed after 3 attempts: temporary c", 3, 3),
        "pdf": (False, "temporary", 1, 0), "cut": (False, "timeout", 1, 1)}
    twice = df.withColumn("run", F.lit(1)).unionByName(df.filter("url = 'not found'").withColumn("success", F.lit(True)).withColumn("run", F.lit(2)))
    runs = {(r["run"], r["url"]): r["success"] for r in resolve_attempts(twice, run_key=("run",)).collect()}
    assert runs[1, "not found"] is False and runs[2, "not found"] is True and len(runs) == len(got) + 1
