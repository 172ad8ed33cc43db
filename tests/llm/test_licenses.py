"""Keywords of signatures, and names that had none of theirs."""

import re

from webloam.llm import licenses


def alternatives(pattern):
    """Texts of a pattern: each way through its groups, optional parts both there and not."""
    group = re.search(r"\(\?:([^()]*)\)(\??)", pattern)
    if group:
        return [x for a in [*group[1].split("|"), *([""] if group[2] else [])] for x in alternatives(pattern[:group.start()] + a + pattern[group.end():])]
    return [pattern.replace(" ?", " "), pattern.replace(" ?", "")] if " ?" in pattern else [pattern]


def test_every_alternative_holds_its_keyword():
    for _, keyword, pattern, _ in licenses.signatures():
        for text in alternatives(pattern):
            assert f" {keyword}" in f" {text}", (keyword, text)


def test_microsoft_public_license_by_name(spark):
    docs = spark.createDataFrame([(1, "Under the Microsoft Public License."), (2, "MS-PL"), (3, "Microsoft Public License (MS-PL)"), (4, "public")], "doc_id long, text string")
    rows = {r.doc_id: (r.labels, len(r.detections), r.score) for r in licenses.scan(docs).collect()}
    assert rows == {1: ("ms-pl", 1, 0.75), 2: ("ms-pl", 1, 0.75), 3: ("ms-pl", 2, 0.75), 4: ("", 0, 0.0)}
