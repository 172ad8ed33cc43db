"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text per language, whose probabilities
reach documents by joins of n-gram counts, with thresholds by quantiles of held-out trusted text.

The model is over characters. Of random or rare words, word n-grams hardly ever repeat, so as many rows as the corpus has words would
be shuffled and most would be unseen; character n-grams repeat, and a block of documents asks for each only once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webloam.llm import common
from webloam.llm.common import block_of, blocks, of_block, put_by_block, settled, shelves_for, tuples

ORDER = 4
#: Bits of a symbol. Code points below half the symbols' number stand for themselves, others share the upper half: Latin, Greek, Cyrillic,
#: Hebrew and Arabic letters are exact, while Chinese, Japanese and Korean ones, and emoji, share a symbol with every 2,048th.
BITS = 12
SYMBOLS = 1 << BITS
START, END = 0, 1
#: Characters whose n-grams are in memory at once.
PART_CHARS = 1 << 20
#: The same where n-grams are looked up and nothing of a part is kept but its sums.
SCORED_CHARS = 1 << 17
#: Trusted texts are dealt into so many folds, each scored by a model of the others. The first fold trains no model of documents.
FOLDS = 5
COUNTS = [f"n{f}" for f in range(FOLDS)]
NATS = [f"nats{f}" for f in range(FOLDS)]
SALTS = 64


def symbols(text: str):
    """The symbols of a text between ORDER - 1 start marks and an end mark."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    half = SYMBOLS // 2
    points = np.where(points < 2, 2, np.where(points < half, points, half + points % half))
    return np.concatenate([np.full(ORDER - 1, START), points, [END]])


def grams(texts: list[str]):
    """The n-gram that ends at each symbol of each text, one after the other, and how many each text has."""
    import numpy as np

    rows = [symbols(t) for t in texts]
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    key = flat.copy()
    for k in range(1, ORDER):
        key[k:] |= flat[:-k] << (BITS * k)
    ends = np.cumsum(sizes)
    own = np.ones(len(flat), bool)
    for k in range(ORDER - 1):
        own[ends - sizes + k] = False
    return key[own], sizes - (ORDER - 1)


def by_language(held: list[tuple]) -> Iterator:
    """(lang, its rows) of a block of rows (id, text, lang)."""
    places: dict[str, list[tuple]] = {}
    for row in held:
        places.setdefault(row[2], []).append(row)
    return iter(places.items())


def parts(held: list[tuple], chars: int = PART_CHARS) -> Iterator:
    """Rows (id, text, ...) of a block, about ``chars`` characters at a time, which bounds the arrays made of them."""
    part, size = [], 0
    for row in held:
        part.append(row)
        size += len(row[1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def folds_of(marks: str, shelves: int, block: int) -> dict:
    """The folds of a block's trusted texts by their ids. Each block has a row at least."""
    found = of_block(marks, shelves, block, ["id", "fold"])
    if found is None or not len(found):
        raise RuntimeError("two passes over the documents disagree; settle them first")
    return {i: f for i, f in zip(found["id"].to_pylist(), found["fold"].to_pylist()) if i is not None}


def name_of(fold, lang):
    """The name of the model that is made of a language's trusted texts but those of the fold."""
    return F.concat(F.lit(f"{fold}:"), lang) if isinstance(lang, Column) else f"{fold}:{lang}"


def for_models(rows: DataFrame, columns: list[str], value) -> DataFrame:
    """``lang`` (a model's name), ``columns`` and ``n`` of each row, for each model whose ``value(fold)`` is not NULL. One pass over the rows."""
    each = F.array(*[F.struct(name_of(f, F.col("lang")).alias("lang"), value(f).cast("long").alias("n")) for f in range(FOLDS)])
    return rows.select(*columns, F.explode(each).alias("_model")).select("_model.lang", *columns, "_model.n").filter("n IS NOT NULL")


def counted(texts: DataFrame, marks: str, shelves: int) -> DataFrame:
    """For each block: every n-gram of its documents by language, once, with its counts in trusted texts of each fold (0 where none has it)
    and ``n``, those of the folds that train."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for block, held in blocks(tuples(batches), lambda r: len(r[1])):
            fold = folds_of(marks, shelves, block)
            for lang, own in by_language(held):
                some, counts = [], []
                for part in parts(own):
                    key, sizes = grams([r[1] for r in part])
                    fold_of = np.repeat(np.array([fold.get(r[0], FOLDS) for r in part]), sizes)
                    for f in np.unique(fold_of):
                        known, n = np.unique(key[fold_of == f], return_counts=True)
                        some.append(known)
                        counts.append((f, n))
                known, at = np.unique(np.concatenate(some), return_inverse=True)
                count, first = np.zeros((FOLDS, len(known)), np.int64), 0
                for f, n in counts:
                    if f < FOLDS:
                        np.add.at(count[f], at[first:first + len(n)], n)
                    first += len(n)
                for cut in range(0, len(known), 100_000):
                    some = known[cut:cut + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), block)), pa.array([lang] * len(some), pa.string()), pa.array(some),
                         *[pa.array(count[f, cut:cut + 100_000]) for f in range(FOLDS)], pa.array(count[1:, cut:cut + 100_000].sum(axis=0))],
                        ["block", "lang", "gram", *COUNTS, "n"])

    return texts.mapInArrow(run, "block long, lang string, gram long, " + ", ".join(f"{c} long" for c in COUNTS) + ", n long")


def discounts(grams_: DataFrame) -> DataFrame:
    """``d1``, ``d2``, ``d3`` by language, from how many n-grams have one, two, three and four occurrences."""
    of = lambda k: F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}")
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = lambda k: F.when(usable, F.least(F.greatest(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.1)), F.lit(float(k)))) \
        .otherwise(k / 2).alias(f"d{k}")
    return grams_.groupBy("lang").agg(*[of(k) for k in range(1, 5)]).select("lang", d(1), d(2), d(3))


def discount(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def probabilities(top: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``p``: P(last symbol | the others) for all rows of ``top`` (lang, gram, n), also where n is 0.

    The top order uses counts, lower ones how many symbols precede an n-gram. Orders join on context and on suffix, by language.
    """
    levels = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << (BITS * k)) - 1
        # settled, since an order reads its level three times: the plan of the lowest one would hold all levels as often, which the driver pays
        levels[k] = settled(
            levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")), f"level{k}")
    lower = None
    for k in range(1, ORDER + 1):
        rows = levels[k].join(discounts(levels[k]), "lang").withColumn("context", F.shiftright("gram", BITS))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(discount(F.col("n"))).alias("kept_back"))
        rows = rows.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))).join(
                lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
        p = F.when(F.col("total") > 0, (F.greatest(F.col("n") - discount(F.col("n")), F.lit(0.0)) + F.col("kept_back") * F.col("q")) / F.greatest(F.col("total"), F.lit(1))).otherwise(F.col("q"))
        lower = settled(rows.select("lang", "gram", p.alias("p")), f"order{k}")
    return lower


def scored(texts: DataFrame, marks: str, answers: str, shelves: int) -> DataFrame:
    """``id``, ``lang``, ``n_symbols`` (characters and the end), ``nats`` (the sum of -ln p) of documents, by their block's answers, and of
    trusted ones ``fold`` and ``held_nats``, by the model that their fold is not in."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for block, held in blocks(tuples(batches), lambda r: len(r[1])):
            fold = folds_of(marks, shelves, block)
            found = of_block(answers, shelves, block, ["lang", "gram", *NATS])
            if found is None or not len(found):
                raise RuntimeError("two passes over the documents disagree; settle them first")
            # names as numbers: a Python string for each n-gram would take more than all the rest
            names = {name: k for k, name in enumerate(pc.unique(found["lang"]).to_pylist())}
            langs = pc.index_in(found["lang"], pa.array(names, pa.string())).to_numpy()
            gram, nats = found["gram"].to_numpy(), [found[c].to_numpy() for c in NATS]  # NULL: NaN
            del found
            for lang, own in by_language(held):
                mine = np.flatnonzero(langs == names.get(lang, -1))
                mine = mine[np.argsort(gram[mine])]
                known = gram[mine]

                def cost_of(texts_, cost):
                    key, sizes = grams(texts_)
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    if not len(known) or not (known[at] == key).all() or np.isnan(cost[at]).any():
                        raise RuntimeError("two passes over the documents disagree; settle them first")
                    return sizes, np.add.reduceat(cost[at], np.cumsum(sizes) - sizes)

                models = {f: nats[f][mine].astype(np.float64) for f in {0, *(fold[r[0]] for r in own if r[0] in fold)}}
                for part in parts(own, SCORED_CHARS):
                    sizes, total = cost_of([r[1] for r in part], models[0])
                    folds = [fold.get(r[0]) for r in part]
                    other = [None if f is None else total[k] for k, f in enumerate(folds)]
                    for f in {*folds} - {None, 0}:
                        at = [k for k, x in enumerate(folds) if x == f]
                        for k, n in zip(at, cost_of([part[k][1] for k in at], models[f])[1]):
                            other[k] = n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in part], id_type), pa.array([lang] * len(part), pa.string()), pa.array(sizes), pa.array(total),
                         pa.array(folds, pa.int32()), pa.array(other, pa.float64())],
                        ["id", "lang", "n_symbols", "nats", "fold", "held_nats"])

    id_type = to_arrow_type(texts.schema["id"].dataType)
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, lang string, n_symbols long, nats double, fold int, held_nats double")


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, ``lang``, ``n_symbols``, ``perplexity`` (NULL where no trusted text of the language trains), ``held_out``, and of trusted texts
    ``held_perplexity`` (else NULL, and where no trusted text of the language is in another fold), for each row.

    ``trusted`` has the ids of trusted texts, dealt into FOLDS by a hash of the id. The first fold is held out of training the model that
    scores documents; ``held_perplexity`` is by a model of all folds but the text's own, so every trusted text has one.
    Documents are read four times (twice for lengths only) and never shuffled: what moves are the distinct n-grams of each block, to the
    shard of their count and back, so it grows with the input. Rows must lie in the same partitions each time, as those
    of files do; passes that disagree raise an error.
    """
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    # splits smaller than a block are joined, as far as all cores stay busy: a block asks for each n-gram once
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // common.BLOCK_CHARS), 1))
    ids = trusted.select(F.col(id_col).cast(dict(texts.dtypes)["id"]).alias("id")).dropna().distinct()
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int")
    placed = settled(block_of(texts), "placed")
    shelves = shelves_for(placed)
    # a row without an id for each block, so that a block that is not there is told from one without trusted texts
    every = placed.select("block").distinct().select("block", F.lit(None).cast(dict(texts.dtypes)["id"]).alias("id"), F.lit(None).cast("int").alias("fold"))
    marks = put_by_block(placed.join(ids, "id").select("block", "id", fold.alias("fold")).unionByName(every), shelves, "marks")
    asked = settled(counted(texts, marks, shelves), "asked")
    total = sum((F.col(c) for c in COUNTS), F.lit(0).cast("long"))
    whole = settled(asked.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in COUNTS], F.sum("n").alias("n")), "whole")
    # the model of documents knows all their n-grams; those that leave another fold out need only the trusted texts'
    tops = for_models(whole, ["gram"], lambda f: F.col("n") if f == 0 else F.when(total > 0, total - F.col(f"n{f}")))
    # a row of all models' answers for each n-gram, so that a block asks once and not for each model
    model = probabilities(tops).select(
        F.substring_index("lang", ":", 1).alias("_fold"), F.expr("substring(lang, instr(lang, ':') + 1)").alias("lang"), "gram", (-F.log("p")).cast("float").alias("_nats"))
    model = model.groupBy("lang", "gram").agg(*[F.max(F.when(F.col("_fold") == str(f), F.col("_nats"))).alias(NATS[f]) for f in range(FOLDS)])
    wanted = asked.select("block", "lang", "gram", *[(F.lit(f == 0) | (F.col(COUNTS[f]) > 0)).alias(f"_wants{f}") for f in range(FOLDS)])
    answers = put_by_block(wanted.join(model, ["lang", "gram"]).select(
        "block", "lang", "gram", *[F.when(F.col(f"_wants{f}"), F.col(NATS[f])).alias(NATS[f]) for f in range(FOLDS)]), shelves, "answers")
    others = F.array(*[F.max(total - F.col(c)) > 0 for c in COUNTS]).alias("_others")
    trained = whole.groupBy("lang").agg(others).select(F.col("lang").alias("_lang"), "_others")
    salt = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SALTS)).cast("int")
    trained = trained.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = settled(scored(texts, marks, answers, shelves), "scored")
    return rows.join(trained, (F.col("lang") == F.col("_lang")) & (salt == F.col("_salt")), "left").select(
        "id", "lang", "n_symbols", F.when(F.col("_others")[0], F.exp(F.col("nats") / F.col("n_symbols"))).alias("perplexity"),
        F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"),
        F.when(F.get("_others", F.col("fold")), F.exp(F.col("held_nats") / F.col("n_symbols"))).alias("held_perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quantile: float = 0.99, keep_trusted: bool = False) -> DataFrame:
    """``id_col``, ``lang`` (NULL: ''), ``n_symbols``, ``perplexity``, ``threshold`` and ``kept``, for each row of docs.

    A language's threshold is the ``quantile`` of perplexities of its trusted texts, each by a model that it is not in; documents
    above it are rejected, trusted ones too by the model that they are not in, unless ``keep_trusted``. Where a language has no trusted text to train on, or all its trusted texts are in one fold, nothing is known
    against its documents: perplexity or threshold is NULL and they are kept. NULL texts are empty (their only symbol is the end); repeated rows count
    each; other columns are ignored, so they may have any names; an empty table gives no rows.
    """
    rows = settled(perplexities(docs, trusted, id_col, text_col, lang_col), "perplexities")
    limits = rows.filter(F.col("held_perplexity").isNotNull()).groupBy(F.col("lang").alias("_lang")).agg(
        F.percentile_approx("held_perplexity", quantile, 10_000).alias("threshold"))
    # most rows may be of one language: each threshold stands SALTS times, and rows choose one by their id
    limits = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SALTS)).cast("int")
    kept = F.coalesce(F.coalesce("held_perplexity", "perplexity") <= F.col("threshold"), F.lit(True))
    return rows.join(limits, (F.col("lang") == F.col("_lang")) & (salt == F.col("_salt")), "left").select(
        F.col("id").alias(id_col), "lang", "n_symbols", "perplexity", "threshold",
        (kept | F.col("held_perplexity").isNotNull() if keep_trusted else kept).alias("kept"))
