"""Every stage of the pipeline on odd rows, on columns with clashing names, and on an empty table."""

import pytest

from tests.llm.helpers import PROSE, no_documents, odd_documents
from webloam.llm import near_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, 1, 0), (8, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, "seven wizards boil"), (None, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_and_empty_tables(spark, folder, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_documents(spark)
    for rows in (docs, no_documents(spark)):
        out = stage(spark, rows, folder)
        found = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            kept, given = [repr(r) for r in found], [repr(r) for r in rows.collect()]
            assert set(kept) <= set(given) and len(kept) <= len(given)
        assert found or rows is not docs
    if name == "near duplicates":
        assert sorted(r.doc_id for r in stage(spark, docs, folder).collect() if r.doc_id in (1, 2)) == [1]
    if name == "benchmark decontamination":
        assert not [r for r in stage(spark, docs, folder).collect() if r.doc_id in (1, 2)]


def test_classes_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, PROSE), (5, PROSE), (None, "alone " + PROSE[::-1]), (7, "other words")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.copy_of, r.class_id) for r in near_dedup.near_classes(docs).collect()), key=repr)
    assert found == sorted([(None, 5, 5), (5, 5, 5), (None, None, None), (7, 7, 7)], key=repr)
