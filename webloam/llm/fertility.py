"""Quality rules: repetition and length rules of texts, and fertility of a public tokeniser with bands per language."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.llm.common import settled
from webloam.llm.tokens import Memo

#: Texts whose words are held at once.
BATCH = 250
#: Values that mean a byte rather than a piece in vocabularies with byte fallback: the marks <0x00> to <0xFF>.
BYTE_MARK = "<0x"
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Quantiles that bound a length class's band, and texts it has at least for them. Junk lies low: it has fewer characters to a
#: token and repeats itself.
LOW, HIGH, LEAST = 0.05, 0.99, 100
#: Reach of a fence below the first and above the third quartile, by their distance. Junk lies low; what lies high is short or of many rare
#: words, and clean as a rule. Among labelled texts, fences lose fewer clean ones than tails do, which always cut a twentieth.
FENCES = (1.5, 3.0)
SALTS = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def repeated_words(words: list, size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text holds twice or more."""
    import numpy as np

    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    window = ids
    for k in range(1, size):  # windows of one more word each, numbered anew: exact, and never beyond 64 bits
        m = len(ids) - k
        key = window[:m] * (len(number) + 1) + ids[k:k + m]
        values, window, count = np.unique(key, return_inverse=True, return_counts=True)
        if len(values) == m:
            return 0  # shorter windows are all distinct already
    twice = count[window] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words (as bytes, between ASCII blanks) and COUNTS of a text."""
    words = text.encode().split()
    blanks = sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return words, (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ``lang`` (NULL: ''), COUNTS (long) and MEASURES (double; NULL where the text has no word) of whole texts.

    Tokens are those of each word on its own, so a word is encoded once and remembered. chars_per_token: characters of words by
    tokens; byte_share: the part of tokens that are single bytes for want of a piece; token_entropy: entropy of the text's
    tokens by the most that as many tokens could have (1 where a text has one token). NULL text: none.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary or piece_path())
        is_byte = np.array([model.id_to_piece(i).startswith(BYTE_MARK) for i in range(model.get_piece_size())])
        encode = lambda w: np.array(model.encode(w.decode(), num_threads=1), np.int32).tobytes()
        known = Memo(encode)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                own = [base_counts(t) for t in part.column(1).to_pylist()]
                new = {w for words, _ in own for w in words}.difference(known)
                if len(new) + len(known) > known.size:
                    known.clear()
                new = list(new)
                for k in range(0, len(new), 10_000):
                    some = new[k:k + 10_000]
                    for w, ids in zip(some, model.encode([w.decode() for w in some], num_threads=1)):
                        known[w] = np.array(ids, np.int32).tobytes()
                values = []
                for words, counts in own:
                    ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
                    if not len(ids):
                        values.append((None, None, None))
                        continue
                    share = np.unique(ids, return_counts=True)[1] / len(ids)
                    entropy = float(-(share * np.log(share)).sum() / np.log(len(ids))) if len(ids) > 1 else 1.0
                    values.append((counts[1] / len(ids), float(is_byte[ids].mean()), entropy))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *[pa.array([c[k] for _, c in own], pa.int64()) for k in range(5)],
                     *[pa.array([v[k] for v in values], pa.float64()) for k in range(3)]], [id_col, "lang", *COUNTS, *MEASURES])

    schema = f"`{id_col}` {kind}, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{m} double" for m in MEASURES)
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def length_class() -> Column:
    """Texts of 2^k to 2^(k+1) - 1 words are of class k: how measures spread, and the entropy itself, change with the length."""
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")


def bands(measured: DataFrame) -> DataFrame:
    """Per language, length class and measure, over all texts that pass the base rules: the quantiles LOW and HIGH of the class, and
    the first and third quartile, their distance and the median of words of the whole language.

    A language of alike texts gets a distance of at least a hundredth of its median's size, so ties reject nobody. A class of
    fewer than LEAST texts has no tails to speak of: its quantiles are NULL.
    """
    usual = measured.filter(~base_failed())
    quantiles = lambda m, *q: F.percentile_approx(m, F.array(*[F.lit(x) for x in q]), F.lit(10_000))
    per = usual.groupBy("lang").agg(*[quantiles(m, 0.25, 0.5, 0.75).alias(m) for m in MEASURES], F.percentile_approx("n_words", 0.5).alias("_words"))

    def edges(m: str) -> list[Column]:
        q1, mid, q3 = (F.col(m)[k] for k in range(3))
        return [q1.alias(f"{m}_q1"), q3.alias(f"{m}_q3"), F.greatest(q3 - q1, F.abs(mid) / 100, F.lit(0.01)).alias(f"{m}_wide")]

    fences = per.select(F.col("lang").alias("_lang"), "_words", *[e for m in MEASURES for e in edges(m)])
    tails = usual.groupBy("lang", length_class().alias("_class")).agg(
        F.count(F.lit(1)).alias("_n"), *[quantiles(m, LOW, HIGH).alias(m) for m in MEASURES])
    enough = F.col("_n") >= LEAST
    tails = tails.select("lang", "_class", *[F.when(enough, F.col(m)[k]).alias(f"{m}_{end}") for m in MEASURES for k, end in enumerate(("low", "high"))])
    return tails.join(fences, F.col("lang") == F.col("_lang")).drop("lang")


def fences(measured: DataFrame) -> DataFrame:
    """Per language (``_lang``) and length class (``_class``) of texts that pass the base rules: of each measure the first and third quartile
    and their distance, and ``_words``.

    The quartiles are those of the class, or those of the whole language where the class has fewer than LEAST texts; ``_words`` is
    then the median of words of the language's texts, else NULL. A group of alike texts gets a distance of at least a
    hundredth of its median's size, so ties reject nobody. Nothing is sampled; where most texts are alike none is rejected.
    """
    usual = measured.filter(~base_failed())

    def quartiles(rows: DataFrame, *by: Column) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"), F.percentile_approx("n_words", 0.5).alias("_words"),
            *[F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(m) for m in MEASURES])

    whole = quartiles(usual, F.col("lang"))
    whole = whole.select(F.col("lang").alias("_lang"), F.col("_words").alias("_all_words"), *[F.col(m).alias(f"_all_{m}") for m in MEASURES])
    own = F.col("_n") >= LEAST
    joined = quartiles(usual, F.col("lang"), length_class().alias("_class")).join(whole, F.col("lang") == F.col("_lang"))
    chosen = joined.select("_lang", "_class", F.when(~own, F.col("_all_words")).alias("_words"),
                           *[F.when(own, F.col(m)).otherwise(F.col(f"_all_{m}")).alias(m) for m in MEASURES])

    def edges(m: str) -> list[Column]:
        q1, mid, q3 = (F.col(m)[k] for k in range(3))
        return [q1.alias(f"{m}_q1"), q3.alias(f"{m}_q3"), F.greatest(q3 - q1, F.abs(mid) / 100, F.lit(0.01)).alias(f"{m}_wide")]

    return chosen.select("_lang", "_class", "_words", *[e for m in MEASURES for e in edges(m)])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reach: float = 2.0,
                  vocabulary: str | None = None, fence: tuple[float, float] | None = None) -> DataFrame:
    """``id_col``, COUNTS, ``base_failed``, ``kept``, ``lang`` and MEASURES of each row.

    With ``fence`` (low, high), kept means: the base rules pass, and every measure lies no further below the first quartile of the text's
    language and length class than ``low`` times the quartiles' distance, nor above the third one than ``high`` times. Where the
    class has too few texts the language's quartiles hold, wider for texts shorter than its median by the root of how much.

    Without it, kept means: the base rules pass, and every measure lies in the band of the text's language: between the quantiles LOW and HIGH of
    texts of its length class, and no further from the language's quartiles than ``reach`` times their distance, which also
    holds where a class has too few texts for quantiles. Shorter texts than the median vary more, so that reach is wider by the root of
    how much shorter they are. A language of which no text passes the base rules has no band, and none is needed.
    """
    measured = settled(measure(docs, id_col, text_col, lang_col, vocabulary), "fertility")
    noise = F.greatest(F.lit(1.0), F.sqrt(F.coalesce("_words", F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1))))
    low, high = fence or (reach, reach)
    inside = F.lit(True)
    for m in MEASURES:
        wide = F.col(f"{m}_wide") * noise
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_q1") - wide * low, F.col(f"{m}_q3") + wide * high), F.lit(False))
        if not fence:
            inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    failed = base_failed()
    # most rows may be of one language: each band stands SALTS times, and rows choose one by their id
    salted = (fences if fence else bands)(measured).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")
    own = (F.col("lang") == F.col("_lang")) & (length_class() == F.col("_class")) & (salt == F.col("_salt"))
    return measured.join(salted, own, "left").select(
        id_col, *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"), "lang", *MEASURES)
