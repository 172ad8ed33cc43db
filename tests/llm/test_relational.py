"""Chat formatting, license scan, sharding and WARC archives."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import no_documents, odd_documents
from webloam.llm import chat, licenses, sharding, warc


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss_spans string")


def read_back(rows):
    out = chat.format_chats(rows).withColumns({"turns": chat.read_turns(F.col("formatted")), "learned": chat.learned_text(F.col("formatted"), F.col("loss_spans"))})
    return {r.conv_id: r for r in out.collect()}


def test_chats_read_back_as_they_were(spark):
    rng = random.Random(1)
    bits = ["\\", "<", ">", "</turn>\n", "<join/>", "<turn:user>", "\\l", "\\b", "b", "\n", "é漢😀", "text", " "]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a>b\\<", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
            rows.append((conv if conv else None, turn, role, text, "x", "y"))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = read_back(chats(spark, shuffled))
    assert len(found) == 40
    for conv, r in found.items():
        own = [(role or "", text or "") for c, _, role, text, *_ in rows if c == conv]
        assert [tuple(t) for t in r.turns] == own
        learned = [t for role, t in own if role == "assistant"]
        assert r.learned == "".join(learned) and len(r.loss_spans) == len(learned)
        for span, text in zip(r.loss_spans, learned):
            raw = r.formatted[span.start:span.end]
            assert raw.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\") == text
            assert r.formatted.encode()[span.first_byte:span.end_byte].decode() == raw


def test_turns_of_one_role_share_a_block(spark):
    r = read_back(chats(spark, [(1, 0, "user", "a", "", ""), (1, 1, "user", "b", "", ""), (1, 2, "assistant", "c", "", "")]))[1]
    assert r.formatted == "<turn:user>a<join/>b</turn>\n<turn:assistant>c</turn>\n"


def test_long_conversations_ties_and_none(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", f"t{k}", "", "") for k in range(1500)] + [(2, 1, "user", "b", "", ""), (2, 1, "user", "a", "", ""), (2, None, "user", "z", "", "")]
    found = read_back(chats(spark, rows))
    assert [t.text for t in found[1].turns] == [f"t{k}" for k in range(1500)]
    assert found[1].learned == "".join(f"t{k}" for k in range(1500) if k % 3)
    assert [t.text for t in found[2].turns] == ["z", "a", "b"]
    assert chat.format_chats(chats(spark, [])).count() == 0


def brute_scan(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    spaced = " " + "".join(w + " " for w in words)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split(" ")
        found = [k for k in range(len(words)) if words[k:k + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    matches = []
    for n, (priority, keyword, pattern, label) in enumerate(licenses.signatures()):
        for m in re.finditer(f"(?<= ){pattern}(?= )", spaced):
            assert f" {keyword}" in " " + m[0], (keyword, m[0])
            matches.append((m.start(), m.end(), priority, n, label))
    kept = [m for m in matches if not any(
        o is not m and o[0] <= m[0] and m[1] <= o[1] and o[2] <= m[2] and ((o[0], -o[1], o[2], o[3]) < (m[0], -m[1], m[2], m[3])) for o in matches)]
    base = ",".join(sorted(labels))
    best = min([m[2] for m in kept] + ([2] if places else []), default=None)
    return (len(words), len(places), min(places, default=None), max(places, default=None), base,
            ",".join(sorted(labels | {m[4] for m in kept})), 0.0 if best is None else 1.25 - 0.25 * best)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(2)
    bits = ["Licensed under the Apache License, Version 2.0", "CC BY 4.0", "cc by cc by", "GNU General Public License v3 or later", "all rights reserved",
            "ALL RIGHTS RESERVED.", "the MIT License", "SPDX-License-Identifier: GPL-2.0-or-later", "GPLv2", "see the license", "copyright (c) 2020", "mit", "foo", "bär",
            "redistribution and use in source and binary forms, with or without modification, are permitted", "bsd 3-clause", "general public", "license"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(60)] + [None, "", "...", "cc by " * 300, "ﬀ CC BY", "Kelvin cc by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(1))
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(licenses.signatures()) > 250
    for k, text in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_scan(text), text
    for k in (4, 9):
        for d in rows[k].detections:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[k] or "").lower())
            assert 0 <= d.first_word and d.first_word + d.n_words <= len(words)
    assert licenses.scan(no_documents(spark)).count() == 0
    assert licenses.scan(odd_documents(spark)).count() == odd_documents(spark).count()


def test_curve_visits_each_cell_once_by_single_steps():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1)
        index = sharding.curve_index(list(cells), bits)
        order = cells[:, np.argsort(index)]
        assert sorted(index) == list(range(cells.shape[1]))
        assert (np.abs(np.diff(order, axis=1)).sum(axis=0) == 1).all()


def sharded(spark, docs, path, dims=("n_chars", "lang", "source"), shards=4):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return sharding.with_slots(sharding.write_shards(docs, str(path), shards, list(dims), "text", size, "doc_id"), "doc_id")


def test_shards_are_even_gapless_and_keep_equal_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"text {k % 500} " * (k % 500 % 7 + 1), rng.choice(["en", "de", None]), f"s{k % 11}", k % 500 % 7) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sharded(spark, docs, tmp_path / "a").collect()
    assert sorted(r.doc_id for r in found) == list(range(1500))
    load, texts = {}, {}
    for r in found:
        load.setdefault(r.shard, []).append(r)
        texts.setdefault(r.text, set()).add(r.shard)
    sizes = [sum(len(r.text) + 1 for r in own) for own in load.values()]
    assert set(load) == {0, 1, 2, 3} and max(sizes) - min(sizes) < 0.02 * sum(sizes)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in load.values())
    assert all(len(s) == 1 for s in texts.values())


def test_files_prune_on_each_dimension(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"t{k}", "en", "s", rng.randint(0, 999), rng.randint(0, 999)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, a long, b long")
    found = sharded(spark, docs, tmp_path / "a", dims=("a", "b"), shards=16)
    boxes = found.groupBy("shard").agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).collect()
    assert len(boxes) == 16
    for lo, hi in ((1, 2), (3, 4)):  # a range of one dimension touches few shards, whichever it is
        assert sum(b[lo] <= 500 <= b[hi] for b in boxes) <= 8


def test_one_text_on_most_rows_is_split(spark, tmp_path):
    docs = spark.createDataFrame([(k, "same", "en", "s", 1) for k in range(900)] + [(k, f"t{k}", "en", "s", 1) for k in range(900, 1000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = sharded(spark, docs, tmp_path / "a").collect()
    sizes = [sum(len(r.text) + 1 for r in found if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 20


def test_shards_of_odd_documents(spark, tmp_path):
    found = sharded(spark, odd_documents(spark), tmp_path / "a", shards=3)
    assert found.count() == odd_documents(spark).count() and found.filter("slot is null or shard is null").count() == 0
    assert sharded(spark, no_documents(spark), tmp_path / "b").count() == 0


def test_archive_reads_back(spark, tmp_path):
    long = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "http://c", long + "!"), (4, "http://d", None), (5, "http://e", "short"), (6, "http://f", "short"),
            (7, "http://g", "x\r\n\r\nWARC/1.1\r\n" * 300), (None, "http://h", long)]
    path = (tmp_path / "w").as_uri()
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    found = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(found) == 8
    for page_id, _, html in rows:
        r, body = found[f"urn:page:{'none' if page_id is None else page_id}"], (html or "").encode()
        copy = html == long and page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", "urn:page:2") if copy else ("response", None))
        assert r.payload == (b"" if copy else body) and r.payload_length == len(body)
        assert r.payload_digest == "sha1:" + hashlib.sha1(body).hexdigest()
    assert found["urn:page:1"].target_uri == "http://a/%0D%0AX: y" and found["urn:page:2"].target_uri is None
    heads = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r.record_id for r in heads.collect()] == ["urn:page:1"] and heads.filter("payload is not null").count() == 0
    assert "Filter (" not in warc.read_warc(spark, path).filter("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    warc.write_warc(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), (tmp_path / "e").as_uri())


def test_archives_of_other_writers(tmp_path):
    import gzip

    records = [warc.record_of({"record_type": t, "record_id": str(k), "target_uri": "u", "date": None, "payload_digest": None, "payload_length": None, "refers_to": None,
                               "payload": b"p" * (5000 * k)}) for k, t in enumerate(["response", "request", "response"])]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    from pyspark.sql.datasource import EqualTo

    for wanted in (None, "response"):
        for payload in (True, False):
            reader = warc.WarcReader(tmp_path.as_uri(), payload, 1 << 20)
            assert list(reader.pushFilters([EqualTo(("record_type",), wanted)] if wanted else [])) == []
            rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
            ids = ["0", "1", "2"] if wanted is None else ["0", "2"]
            assert [r["record_id"] for r in rows] == ids * 3
            assert all(r["payload"] == (b"p" * (5000 * int(r["record_id"])) if payload else None) for r in rows)


def test_strings_that_begin_alike_are_told_apart(spark):
    rng = random.Random(8)
    urls = [f"https://www.example.com/{rng.choice('abcdef')}/{rng.randrange(10 ** 6)}" for _ in range(2000)] + ["https://www.example.com/same"] * 500
    df = spark.createDataFrame([(k, u, k % 97) for k, u in enumerate(urls)] + [(9999, None, None)], "id int, url string, n int")
    found = sharding.quantised(df, ["url", "n"], bits=3).collect()
    cells = {}
    for r in found:
        cells.setdefault(r._cell_url, []).append(r.url)
    assert cells.pop(0) == [None] and sorted(cells) == list(range(1, max(cells) + 1)) and max(cells) >= 5
    assert all(max(cells[k]) < min(cells[k + 1]) for k in range(1, max(cells)))
    ordered = sorted(urls)
    cuts = sorted({ordered[-(-k * len(ordered) // 7) - 1] for k in range(1, 7)})
    assert sharding.string_cuts(df, "url", 7) == cuts
    assert sharding.string_cuts(df.limit(0), "url", 7) == []


def test_equal_short_payloads_are_no_group(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "" if k % 2 else "short") for k in range(400)] + [(400 + k, f"v{k}", "x" * 1000) for k in range(3)],
                                  "page_id long, url string, html string")
    rows = warc.page_records(pages).collect()
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in rows}
    assert len(rows) == 403 and sum(k == "revisit" for k, _ in kinds.values()) == 2
    assert kinds["urn:page:400"] == ("revisit", "urn:page:402") and kinds["urn:page:7"] == ("response", None)
