"""The corpus pipeline, stage by stage and as a whole."""

import re

import corpus_pipeline

from larkspur.llm.common import materialise

SF = "/root/testdata/sf0.001"


def through(spark, docs):
    """Each stage's result, written and read again, up to the packed pieces."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns_and_the_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    *kept, packed = through(spark, docs)
    assert all(x.columns == docs.columns and x.count() > 50 for x in kept)
    assert packed.where("start = 0").count() == kept[-1].count()


def test_odd_rows_and_planted_copies(spark, odd_documents):
    """Nulls, empty and long texts, repeated identifiers, an extra column; exact and near copies planted among them."""
    base = " ".join(f"lorem{i} of the" for i in range(60))
    other = " ".join(f"dolor{i} and a" for i in range(60))
    planted = [(100 + i, base, "en", "a", 1, None) for i in range(6)] + [(110 + i, f"{base} tail{i}", "en", "b", 1, None) for i in range(5)] + [(130, other, "en", "b", 1, None)]
    docs = odd_documents.unionByName(spark.createDataFrame(planted, odd_documents.schema))
    _, judged, once, apart, mixed, packed = through(spark, docs)
    kept = {r.doc_id for r in judged.collect()}
    assert all(x.columns == docs.columns for x in (judged, once, apart, mixed))
    texts = lambda df: sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in df.collect())
    assert texts(once) == sorted(set(texts(judged)))
    ids = {r.doc_id for r in apart.collect()}
    assert len(ids & {*range(100, 106), *range(110, 115)}) == (1 if kept & {*range(100, 115)} else 0)
    assert (130 in ids) == (130 in kept)
    assert {r.doc_id for r in mixed.collect()} <= ids
    assert packed.where("start = 0").count() == mixed.count()
    assert all(x.count() == 0 for x in through(spark, docs.limit(0))[1:])


def test_results_of_two_runs_are_both_readable(spark):
    a = corpus_pipeline.run(spark, SF)
    b = corpus_pipeline.run(spark, SF)
    assert b.count() == a.count() > 0 and "sequence_id" in a.columns
