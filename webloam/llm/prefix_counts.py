"""Token counts of every prefix of every text, by dynamic programming, and the questions they answer without encoding again."""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.llm.tokens import default_path, word_bpe

#: Texts that are encoded together.
BATCH = 1000


def token_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ``text`` (NULL: empty) and ``prefix_tokens`` array<int>: entry i is the exact token count of the first i characters.

    The last entry is the count of the whole text; an empty text has the one entry 0. Counts need not rise from entry to
    entry: a longer prefix can merge into fewer tokens. Special strings inside texts count as the library takes them by default.
    Other columns are ignored, repeated rows give repeated rows, an empty table gives none. Map only, whole texts,
    in time that grows with their length, also where nothing separates words.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)[id_col]

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = word_bpe(vocabulary or default_path())
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                gc.disable()  # nothing below makes cycles, and walking the memos is slow
                bpe.remember(texts)
                own = [bpe.prefix_counts(t) for t in texts]
                gc.enable()
                ends = np.zeros(len(own) + 1, np.int32)
                np.cumsum([len(x) for x in own], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], [id_col, "text", "prefix_tokens"])

    return rows.mapInArrow(count, f"`{id_col}` {kind}, text string, prefix_tokens array<int>")


def n_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(prefix_tokens, -1).cast("long")


def longest_prefix(prefix_tokens: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix that needs no more than ``budget`` tokens."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits).cast("long")


def tokens_of_first(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters; of the whole text where it has fewer."""
    chars = chars if isinstance(chars, Column) else F.lit(chars)
    return F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1).cast("int")).cast("long")
