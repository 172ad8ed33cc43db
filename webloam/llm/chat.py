"""Conversations as marked texts with a loss mask, and back again, in Spark expressions only.

A block is ``<turn:ROLE>TEXT</turn>`` and a line feed; the texts of turns of one role in a row share a block, parted by ``<join/>``.
Inside roles and texts, ``\\``, ``<`` and ``>`` stand as ``\\b``, ``\\l`` and ``\\g``, so no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, JOIN, CLOSE = "<turn:", ">", "<join/>", "</turn>\n"
#: Numbers whose running totals are taken together, so that totals of very many stay cheap.
STEP = 256


def escape(text: Column) -> Column:
    for plain, own in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(own))
    return text


def unescape(text: Column) -> Column:
    for plain, own in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(own), F.lit(plain))
    return text


def totals_before(numbers: Column) -> Column:
    """For each of the numbers (long), what those before it sum to."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    append = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) - 1, F.lit(0)), F.lit(STEP)), lambda k: F.slice(numbers, k + 1, STEP))
    bases = F.aggregate(F.transform(groups, total), F.array(F.lit(0).cast("long")), append)
    inside = F.transform(F.arrays_zip(groups.alias("g"), bases.alias("b")), lambda z: F.slice(
        F.aggregate(z["g"], F.array(z["b"]), append), F.lit(1), F.size(z["g"])))
    return F.flatten(F.filter(inside, lambda x: x.isNotNull()))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 learned_role: str = "assistant") -> DataFrame:
    """``conv_col``, ``formatted``, and ``loss_spans``: where in it the texts of ``learned_role`` lie, one span a turn, in order.

    Spans hold ``start`` and ``end`` in characters, ``first_byte`` and ``end_byte`` in bytes of UTF-8. NULL roles and texts are
    empty; a NULL conversation is one of its own; turns of one number go by role, then text, NULL numbers first; repeated rows are
    turns of their own. Other columns are ignored, an empty table gives no rows. A conversation is one row of the
    result, so its turns meet in one task whatever the plan; everything done there is linear in them.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_ = rows.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    turns = F.col("_turns")
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    merged = sorted_.withColumn("_starts", starts).withColumn("_blocks", F.transform("_starts", lambda s, k: F.struct(
        F.get(turns, s)["role"].alias("role"),
        F.transform(F.slice(turns, s + 1, F.coalesce(F.get("_starts", k + 1), F.size(turns)) - s), lambda t: t["text"]).alias("texts"))))
    block = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(NAMED), F.array_join(F.transform(b["texts"], escape), JOIN), F.lit(CLOSE))

    def extents(size) -> Column:
        """For each turn in blocks: what stands before its text (marks), its text, what stands behind it."""
        return F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
            F.when(i == 0, len(OPEN) + len(NAMED) + size(escape(b["role"]))).otherwise(len(JOIN)).cast("long").alias("head"),
            size(escape(t)).cast("long").alias("body"),
            F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).cast("long").alias("tail"),
            b["role"].alias("role")))))

    placed = merged.select(
        conv_col, F.array_join(F.transform("_blocks", block), "").alias("formatted"), extents(F.length).alias("_c"), extents(F.octet_length).alias("_b"))
    all_of = lambda c: totals_before(F.transform(c, lambda x: x["head"] + x["body"] + x["tail"]))
    placed = placed.withColumns({"_c0": all_of("_c"), "_b0": all_of("_b")})
    spans = F.transform("_c", lambda c, i: F.struct(
        (F.get("_c0", i) + c["head"]).alias("start"), (F.get("_c0", i) + c["head"] + c["body"]).alias("end"),
        (F.get("_b0", i) + F.get("_b", i)["head"]).alias("first_byte"),
        (F.get("_b0", i) + F.get("_b", i)["head"] + F.get("_b", i)["body"]).alias("end_byte"), c["role"].alias("role")))
    learned = F.transform(F.filter(spans, lambda s: s["role"] == learned_role), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["first_byte"].alias("first_byte"), s["end_byte"].alias("end_byte")))
    return placed.select(conv_col, "formatted", learned.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    head = lambda b: F.substring_index(b, NAMED, 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.length(head(b)) + F.lit(len(NAMED) + 1)), JOIN, -1),
        lambda t: F.struct(unescape(F.substr(head(b), F.lit(len(OPEN) + 1))).alias("role"), unescape(t).alias("text")))))


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    raw = formatted.cast("binary")
    part = lambda s: F.substr(raw, (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int"))
    return F.array_join(F.transform(loss_spans, lambda s: unescape(part(s).cast("string"))), "")
