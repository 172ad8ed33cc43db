"""Fill-in-the-middle: a text's prefix, middle and suffix change places by rotations inside one bytearray, and back again."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
BATCH = 1000
#: Bytes that a reversal holds twice.
STRIP = 1 << 16


def reverse(buffer: bytearray, a: int, b: int) -> None:
    """Reverse buffer[a:b] in its place, strip by strip from both ends."""
    while b - a > 1:
        n = min(STRIP, (b - a) // 2)
        left = buffer[a:a + n]
        buffer[a:a + n] = buffer[b - n:b][::-1]
        buffer[b - n:b] = left[::-1]
        a, b = a + n, b - n


def rotate(buffer: bytearray, a: int, middle: int, b: int) -> None:
    """Exchange buffer[a:middle] and buffer[middle:b]: each is reversed, then both together."""
    reverse(buffer, a, middle)
    reverse(buffer, middle, b)
    reverse(buffer, a, b)


def byte_at(text: bytes, chars: int, n: int) -> int:
    """Where code point number ``chars`` of n begins."""
    if len(text) == n or not chars:
        return chars
    import numpy as np

    at, seen = 0, 0  # scan on, strip by strip, over bytes that begin a code point
    while True:
        begins = np.flatnonzero((np.frombuffer(text, np.uint8, min(STRIP, len(text) - at), at) & 0xC0) != 0x80)
        if seen + len(begins) > chars:
            return at + int(begins[chars - seen])
        seen, at = seen + len(begins), at + STRIP
        if at >= len(text):
            return len(text)


def rearranged(text: bytes, form: str, first: int, second: int, marks: list[bytes]) -> bytearray:
    """The text with marks, its middle from byte ``first`` to ``second``, in the order of the form."""
    prefix, suffix, middle = marks
    out = bytearray(text)
    for at, mark in ((second, suffix), (first, middle), (0, prefix)):  # as prefix, middle, suffix at first
        out[at:at] = mark
    to_middle = len(prefix) + first
    to_suffix = to_middle + len(middle) + second - first
    rotate(out, to_middle if form == "psm" else 0, to_suffix, len(out))
    return out


def put_back(output: bytes, form: str, marks: list[bytes]) -> bytearray:
    """The text that ``rearranged`` was given, from what it gave and the form."""
    prefix, suffix, middle = marks
    out = bytearray(output)
    at = len(out) - (out.find(middle if form == "psm" else prefix) - out.find(suffix))  # the suffix comes to lie there
    rotate(out, out.find(suffix), out.find(middle if form == "psm" else prefix), len(out))
    del out[at:at + len(suffix)]
    at = out.find(middle)
    del out[at:at + len(middle)]
    del out[:len(prefix)]
    return out


def checked(marks: tuple[str, str, str]) -> list[bytes]:
    """The marks as bytes; an error where the end of one could be the start of another, or one could lie in another."""
    raw = [m.encode() for m in marks]
    for (i, a), (j, b) in product(enumerate(raw), repeat=2):
        if not a or i != j and a in b or any(a.endswith(b[:k]) for k in range(1, len(b) + (i != j))):
            raise ValueError(f"marks that can be mistaken for each other: {marks}")
    return raw


def hash_part(id_col: str, seed: str, k: int) -> Column:
    """The k-th group of 8 digits of the hash of seed and id, as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = 90, spm_rate: int = 20,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``id_col``, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (long; NULL where plain) and ``output`` of each row.

    Cuts, and whether a text changes, follow from the seed and the id (NULL: an empty one), so a run again gives the same. ``rate`` of
    100 texts change, ``spm_rate`` of 100 of these with the suffix first. A text that is empty (NULL counts as empty) or holds a mark
    stays plain. Repeated rows give repeated rows, other columns are ignored, an empty table gives no rows. Map only, whole texts.
    """
    raw = checked(marks)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), F.length(text).cast("long").alias("n"))
    cuts = [F.pmod(hash_part(id_col, seed, k), F.col("n") + 1) for k in (0, 1)]
    held = F.lit(False)
    for m in marks:
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | held | (F.pmod(hash_part(id_col, seed, 2), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(hash_part(id_col, seed, 3), F.lit(100)) < spm_rate, "spm").otherwise("psm")
    rows = rows.select(id_col, "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    kind = dict(rows.dtypes)[id_col]

    def change(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out = []
                for text, n, form, a, b in zip(part.column(1).cast(pa.binary()).to_pylist(), *(part.column(k).to_pylist() for k in range(2, 6))):
                    out.append(text if form == "plain" else bytes(rearranged(text, form, byte_at(text, a, n), byte_at(text, b, n), raw)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 2, 3, 4, 5)), pa.array(out, pa.binary()).cast(pa.string())],
                                                 [id_col, "n", "form", "a", "b", "output"])

    changed = rows.mapInArrow(change, f"`{id_col}` {kind}, n long, form string, a long, b long, output string")
    cut = F.col("form") != "plain"
    return changed.select(id_col, "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), "output")


def restored(changed: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``changed`` with ``restored``: the text, from its columns ``output`` and ``form`` alone (NULL where one of them is)."""
    raw = checked(marks)
    columns = [c for c in changed.columns if c != "restored"]
    at_output, at_form = columns.index("output"), columns.index("form")
    rows = changed.select(*columns)
    schema = rows.withColumn("restored", F.lit(None).cast("string")).schema

    def back(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            outputs = batch.column(at_output).cast(pa.binary()).to_pylist()
            texts = [x if x is None or form == "plain" else None if form is None else bytes(put_back(x, form, raw))
                     for x, form in zip(outputs, batch.column(at_form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*columns, "restored"])

    return rows.mapInArrow(back, schema)
