"""Thresholds of the perplexity classifier: the quantile of trusted texts, each scored by a model that it is not in."""

import random

from pyspark.sql import functions as F

from tests.llm.helpers import PROSE
from webloam.llm import kneser_ney


def test_few_trusted_texts_give_the_quantile_itself(spark):
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(kneser_ney.FOLDS))
    ids = [(r.id, r.fold) for r in spark.range(200).select("id", fold.alias("fold")).collect()]
    trusted = [next(i for i, f in ids if f == k) for k in (1, 2, 3)]  # none in the first fold
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(PROSE.split()) for _ in range(60)), "en") for i in [*trusted, *range(1000, 1005)]]
    docs += [(2000, "".join(rng.choice("#$%&*QXZ!") for _ in range(300)), "en")]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    held = {r.id: r.held_perplexity for r in kneser_ney.perplexities(frame, known).collect() if r.held_perplexity is not None}
    assert sorted(held) == sorted(trusted)
    rows = {r.doc_id: r for r in kneser_ney.classify(frame, known).collect()}
    assert all(r.threshold == max(held.values()) for r in rows.values())
    assert all(held[i] > rows[i].perplexity for i in trusted)  # it is scored without itself
    assert not rows[2000].kept and all(rows[i].kept for i in trusted)
