"""License scan: ordered signature rules behind keyword tests, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that part words: all of ASCII but digits and letters.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Signatures: priority (1: an identifier or grant, 2: a name, 3: a bare hint), keyword, pattern over words parted by one blank, label.
#: A keyword begins at a word, and every match of its pattern holds it.
#: A place stands for ``{v}`` and ``{V}`` (a version as in the text and in the label). Patterns begin and end at words.
V2 = "(?:v|version )?{v}"
FAMILIES = (
    # copyleft by the version
    ("gpl", ("1 0", "2 0", "3 0", "1", "2", "3"), (
        (1, "gnu", "gnu general public license (?:as published by the free software foundation )?(?:either )?" + V2 + " or (?:at your option )?(?:any )?later", "gpl-{V}-or-later"),
        (1, "spdx license", "spdx license identifier gpl {v} or later", "gpl-{V}-or-later"),
        (1, "spdx license", "spdx license identifier gpl {v} only", "gpl-{V}-only"),
        (1, "spdx license", "spdx license identifier gpl {v}", "gpl-{V}"),
        (2, "general public", "(?:gnu )?general public license " + V2, "gpl-{V}"),
        (2, "gpl", "(?:gnu )?gpl ?" + V2, "gpl-{V}"),
        (2, "gpl", "(?:gnu )?gpl ?" + V2 + " or later", "gpl-{V}-or-later"))),
    ("lgpl", ("2 0", "2 1", "3 0", "2", "3"), (
        (1, "lesser general", "gnu lesser general public license (?:as published by the free software foundation )?(?:either )?" + V2 + " or (?:at your option )?(?:any )?later", "lgpl-{V}-or-later"),
        (1, "spdx license", "spdx license identifier lgpl {v} or later", "lgpl-{V}-or-later"),
        (1, "spdx license", "spdx license identifier lgpl {v} only", "lgpl-{V}-only"),
        (2, "lesser general", "(?:gnu )?lesser general public license " + V2, "lgpl-{V}"),
        (2, "library general", "(?:gnu )?library general public license " + V2, "lgpl-{V}"),
        (2, "lgpl", "lgpl ?" + V2, "lgpl-{V}"))),
    ("agpl", ("1 0", "3 0", "3"), (
        (1, "affero", "gnu affero general public license (?:either )?" + V2 + " or (?:at your option )?(?:any )?later", "agpl-{V}-or-later"),
        (1, "spdx license", "spdx license identifier agpl {v} only", "agpl-{V}-only"),
        (2, "affero", "(?:gnu )?affero general public license " + V2, "agpl-{V}"),
        (2, "agpl", "agpl ?" + V2, "agpl-{V}"))),
    ("gfdl", ("1 1", "1 2", "1 3"), (
        (2, "free documentation", "gnu free documentation license " + V2, "gfdl-{V}"),
        (2, "gfdl", "gfdl ?" + V2, "gfdl-{V}"))),
    ("apache", ("1 0", "1 1", "2 0", "2"), (
        (1, "apache", "licensed under the apache license " + V2, "apache-{V}"),
        (1, "spdx license", "spdx license identifier apache {v}", "apache-{V}"),
        (2, "apache", "apache (?:software )?license " + V2, "apache-{V}"),
        (2, "apache", "apache {v} license", "apache-{V}"))),
    ("mpl", ("1 0", "1 1", "2 0"), (
        (1, "mozilla", "subject to the terms of the mozilla public license " + V2, "mpl-{V}"),
        (1, "spdx license", "spdx license identifier mpl {v}", "mpl-{V}"),
        (2, "mozilla", "mozilla public license " + V2, "mpl-{V}"),
        (2, "mpl", "mpl ?" + V2, "mpl-{V}"))),
    ("epl", ("1 0", "2 0"), (
        (1, "eclipse", "under the terms of the eclipse public license " + V2, "epl-{V}"),
        (2, "eclipse", "eclipse public license " + V2, "epl-{V}"),
        (2, "epl", "epl ?" + V2, "epl-{V}"))),
    ("cddl", ("1 0", "1 1"), (
        (2, "common development", "common development and distribution license " + V2, "cddl-{V}"),
        (2, "cddl", "cddl ?" + V2, "cddl-{V}"))),
    ("eupl", ("1 0", "1 1", "1 2"), (
        (2, "european union", "european union public licen[cs]e " + V2, "eupl-{V}"),
        (2, "eupl", "eupl ?" + V2, "eupl-{V}"))),
    ("artistic", ("1 0", "2 0"), ((2, "artistic", "artistic license " + V2, "artistic-{V}"),)),
    ("afl", ("1 2", "2 0", "2 1", "3 0"), (
        (2, "academic free", "academic free license " + V2, "afl-{V}"),)),
    ("osl", ("1 0", "2 0", "2 1", "3 0"), ((2, "open software", "open software license " + V2, "osl-{V}"),)),
    ("python", ("2", "2 0"), (
        (2, "python", "python software foundation license " + V2, "psf-{V}"),
        (2, "psf", "psf license " + V2, "psf-{V}"))),
    ("bsd", ("0", "1", "2", "3", "4"), (
        (1, "spdx license", "spdx license identifier bsd {v} clause", "bsd-{V}-clause"),
        (2, "bsd", "bsd {v} clause", "bsd-{V}-clause"),
        (2, "bsd", "{v} clause bsd", "bsd-{V}-clause"))),
    ("boost", ("1 0",), ((1, "boost", "distributed under the boost software license " + V2, "bsl-{V}"), (2, "boost", "boost software license(?: " + V2 + ")?", "bsl-{V}"))),
    ("cc", ("1 0", "2 0", "2 5", "3 0", "4 0"), (
        (1, "creativecommons", "creativecommons org licenses by {v}", "cc-by-{V}"),
        (1, "creativecommons", "creativecommons org licenses by sa {v}", "cc-by-sa-{V}"),
        (1, "creativecommons", "creativecommons org licenses by nc {v}", "cc-by-nc-{V}"),
        (1, "creativecommons", "creativecommons org licenses by nd {v}", "cc-by-nd-{V}"),
        (1, "creativecommons", "creativecommons org licenses by nc sa {v}", "cc-by-nc-sa-{V}"),
        (1, "creativecommons", "creativecommons org licenses by nc nd {v}", "cc-by-nc-nd-{V}"),
        (2, "cc by", "cc by {v}", "cc-by-{V}"),
        (2, "cc by", "cc by sa {v}", "cc-by-sa-{V}"),
        (2, "cc by", "cc by nc {v}", "cc-by-nc-{V}"),
        (2, "cc by", "cc by nd {v}", "cc-by-nd-{V}"),
        (2, "cc by", "cc by nc sa {v}", "cc-by-nc-sa-{V}"),
        (2, "cc by", "cc by nc nd {v}", "cc-by-nc-nd-{V}"),
        (2, "creative commons", "creative commons attribution (?:international |unported |generic )?{v}", "cc-by-{V}"),
        (2, "creative commons", "creative commons attribution share ?alike {v}", "cc-by-sa-{V}"),
        (2, "creative commons", "creative commons attribution non ?commercial {v}", "cc-by-nc-{V}"),
        (2, "creative commons", "creative commons attribution no ?deriv(?:ative)?s {v}", "cc-by-nd-{V}"))),
)
SINGLE = (
    (1, "spdx license", "spdx license identifier mit", "mit"),
    (1, "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    (1, "permission to use", "permission to use copy modify and or distribute this software for any purpose", "isc"),
    (1, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (1, "this is free and", "this is free and unencumbered software released into the public domain", "unlicense"),
    (1, "do what", "do what the fuck you want to public license", "wtfpl"),
    (1, "provided as is without", "this software is provided as is without any express or implied warranty", "zlib"),
    (1, "creativecommons", "creativecommons org publicdomain zero 1 0", "cc0-1.0"),
    (1, "spdx license", "spdx license identifier cc0 1 0", "cc0-1.0"),
    (1, "spdx license", "spdx license identifier unlicense", "unlicense"),
    (1, "spdx license", "spdx license identifier isc", "isc"),
    (2, "mit license", "(?:the )?mit license", "mit"),
    (2, "released under", "released under (?:the )?mit", "mit"),
    (2, "distributed under", "distributed under (?:the )?mit", "mit"),
    (2, "licensed under", "licensed under (?:the )?mit", "mit"),
    (2, "expat", "expat license", "mit"),
    (2, "x11", "x11 license", "x11"),
    (2, "isc license", "isc license", "isc"),
    (2, "bsd license", "(?:new |simplified |modified |revised )?bsd license", "bsd"),
    (2, "released under", "released under (?:the )?bsd", "bsd"),
    (2, "distributed under", "distributed under (?:the )?bsd", "bsd"),
    (2, "licensed under", "licensed under (?:the )?bsd", "bsd"),
    (2, "zlib", "zlib license", "zlib"),
    (2, "unlicense", "the unlicense", "unlicense"),
    (2, "cc0", "cc0(?: 1 0)?", "cc0-1.0"),
    (2, "public domain", "dedicated to the public domain", "public-domain"),
    (2, "public domain", "in the public domain", "public-domain"),
    (2, "open font", "sil open font license", "ofl"),
    (2, "open database", "open database license", "odbl"),
    (2, "open data commons", "open data commons attribution license", "odc-by"),
    (2, "microsoft public", "microsoft public license", "ms-pl"),
    (2, "ms pl", "ms pl", "ms-pl"),
    (2, "apache license", "apache license", "apache"),
    (2, "mozilla", "mozilla public license", "mpl"),
    (2, "eclipse", "eclipse public license", "epl"),
    (2, "affero", "(?:gnu )?affero general public license", "agpl"),
    (2, "lesser general", "(?:gnu )?lesser general public license", "lgpl"),
    (2, "creative commons", "creative commons", "cc"),
    (2, "some rights", "some rights reserved", "some-reserved"),
    (3, "proprietary", "proprietary and confidential", "proprietary"),
    (3, "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", "copyright"),
    (3, "licensed under", "licensed under", "unknown-license"),
    (3, "see license", "see license", "license-reference"),
    (3, "see the license", "see the license", "license-reference"),
    (3, "subject to the terms", "subject to the terms", "terms"),
)


def signatures() -> list[tuple[int, str, str, str]]:
    """All rules in order: by priority, then as they stand above."""
    out = [(p, k, pattern.replace("{v}", v), label.replace("{V}", v.replace(" ", ".")))
           for _, versions, rules in FAMILIES for p, k, pattern, label in rules for v in versions]
    return sorted([*out, *SINGLE], key=lambda r: r[0])


def any_keyword(keywords: list[str]) -> str:
    """One pattern for all keywords: a blank, then one of them, told apart by their first letters."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted(set(keywords)):
        own = by_letter.setdefault(k[0], [])
        if not (own and k.startswith(own[-1])):
            own.append(k)
    return " (?:" + "|".join(f"{c}(?:{'|'.join(k[1:] for k in own)})" for c, own in sorted(by_letter.items())) + ")"


def words_of(text: Column) -> Column:
    """The words of a text, A to Z lowered, each with a blank on either side; one blank where there are none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), PARTING, " ")


def matches_of(spaced: Column, number: int, rule: tuple[int, str, str, str]) -> Column:
    """Places where a rule matches: array<struct<start, stop, priority, rule>>, in characters, ``stop`` negated (longer first)."""
    priority, keyword, pattern, _ = rule
    pattern = f"(?<= ){pattern}(?= )"
    found, gaps = F.regexp_extract_all(spaced, F.lit(pattern), F.lit(0)), F.split(spaced, pattern, -1)
    sizes = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))
    at = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,priority:int,rule:int>>").alias("out")), lambda a, s: F.struct(
        (a["at"] + s["gap"] + s["size"]).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            (a["at"] + s["gap"]).alias("start"), (-(a["at"] + s["gap"] + s["size"])).alias("stop"),
            F.lit(priority).alias("priority"), F.lit(number).alias("rule")))).alias("out")))
    none = F.array().cast("array<struct<start:int,stop:int,priority:int,rule:int>>")
    return F.when(F.contains(spaced, F.lit(f" {keyword}")) & F.regexp_like(spaced, F.lit(pattern)), at["out"]).otherwise(none)


def outermost(matches: Column) -> Column:
    """Matches that no other one of the same or a better priority contains; of equal places the first rule stays.

    Matches are taken by start, longer ones first, so one is contained just when an earlier one of at most its number of
    priority reaches as far: the furthest stop by priority decides, in one pass.
    """
    state = F.struct(F.lit(0).alias("s1"), F.lit(0).alias("s2"), F.lit(0).alias("s3"),
                     F.array().cast("array<struct<start:int,stop:int,priority:int,rule:int>>").alias("kept"))

    def take(a: Column, m: Column) -> Column:
        reach = F.greatest(a["s1"], F.when(m["priority"] >= 2, a["s2"]).otherwise(0), F.when(m["priority"] >= 3, a["s3"]).otherwise(0))
        further = lambda k: F.when((m["priority"] == k) & (-m["stop"] > a[f"s{k}"]), -m["stop"]).otherwise(a[f"s{k}"]).alias(f"s{k}")
        return F.struct(further(1), further(2), further(3), F.when(-m["stop"] > reach, F.concat(a["kept"], F.array(m))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(matches), state, take)["kept"]


def stands(phrase: list[str]):
    """A test whether the phrase's words stand from a word of ``_words`` on."""
    def test(i: Column) -> Column:
        ok = F.lit(True)
        for k, word in enumerate(phrase):
            ok = ok & F.coalesce(F.get("_words", i + k) == word, F.lit(False))
        return ok
    return test


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections of whole texts.

    ``id_col``; n_words; n_base, first_word, last_word (long): how many places of BASE there are, and the words at which the
    first and last start (NULL where there is none); base_labels; labels (those and the detections' own), distinct, sorted, comma-joined;
    detections array<struct<label, priority, first_word, n_words>>; score (double): 0 without detections, else what their
    best priority is worth (1, 0.75, 0.5; base places count as 0.75).
    NULL texts are empty; other columns are ignored; repeated rows give repeated rows. Map only. Texts that hold no keyword cost
    one pass to split words and one test for all keywords together; rules run on the others, each behind its own keyword.
    """
    rules = signatures()
    spaced = F.col("_spaced")
    rows = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("_spaced"))
    hit = F.regexp_like(spaced, F.lit(any_keyword([k for _, k, _, _ in rules] + [phrase for phrase, _ in BASE])))
    n_words = (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("long")

    none = F.array().cast("array<int>")
    places = [F.when(F.contains(spaced, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size("_words") - 1), stands(phrase.split(" "))))
              .otherwise(none).alias(label) for phrase, label in BASE]
    words = F.when(F.col("_hit"), F.split(F.trim(spaced), " ")).otherwise(F.array().cast("array<string>"))
    found = F.flatten(F.array(*[matches_of(spaced, n, r) for n, r in enumerate(rules)]))
    nothing = F.array().cast("array<struct<start:int,stop:int,priority:int,rule:int>>")
    near = rows.withColumns({"_n": n_words, "_hit": hit}).withColumns({"_words": words, "_found": F.when(F.col("_hit"), outermost(found)).otherwise(nothing)}).select(id_col, "_n", "_spaced", "_found", F.struct(*places).alias("_base"))
    labels = F.array(*[F.lit(r[3]) for r in rules])
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    detections = F.transform("_found", lambda m: F.struct(
        F.get(labels, m["rule"]).alias("label"), m["priority"].alias("priority"),
        (blanks(F.substr(spaced, F.lit(1), m["start"])) - 1).cast("long").alias("first_word"),
        (blanks(F.substr(spaced, m["start"] + 1, -m["stop"] - m["start"])) + 1).cast("long").alias("n_words")))
    all_places = F.concat(*[F.col("_base")[label] for _, label in BASE])
    base = F.array_compact(F.array(*[F.when(F.size(F.col("_base")[label]) > 0, F.lit(label)) for _, label in BASE]))
    best = F.array_min(F.concat(F.transform("_found", lambda m: m["priority"]), F.when(F.size(all_places) > 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))))
    return near.select(
        id_col, F.col("_n").alias("n_words"), F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("_found", lambda m: F.get(labels, m["rule"]))))), ",").alias("labels"),
        F.when(best.isNull(), 0.0).otherwise(1.25 - best * 0.25).cast("double").alias("score"), detections.alias("detections"))
