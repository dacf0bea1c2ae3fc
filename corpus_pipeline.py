"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents, extra ones too. A stage's result names its call in its first column's metadata, which Parquet keeps: when the
caller has written and reread it, the next stage removes the scratch tables of that very call and of no other, so several
runs of one session do not meet. The last stage's tables stay as long as its result may be read.

Defined results: null texts count as empty; the classifier gives empty texts the share of good labels, so they stay or go
together, and all stay where there is nothing to learn from; the exact stage keeps one row of equal texts (the smallest
identifier, null last), so at most one empty text; the near-duplicate stage keeps every row without words and one row of
each component; the mixing stage keeps rows without words once; equal rows are mixed equally often; the packing stage gives
every row at least one piece, its end id; an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, jaccard, mixing, packing, quality
from larkspur.llm.common import discard, discard_maker, made_by, materialise, owned_tables, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of an Arrow batch between the JVM and a Python worker. Stages carry whole texts, twice in some, and every task holds a
#: batch on both sides; Spark's own limit of 64 MB a batch is a tenth of a small executor.
ARROW_BYTES = 8 << 20


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_maker(docs)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        call = uuid4().hex
        with owned_tables(call):
            return made_by(f(spark, docs, sf_dir), call)

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays."""
    return exact_dedup.drop_exact_copies(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other by links (five-word shingles, similarity 0.8) one stays."""
    return jaccard.drop_near_duplicates(docs, k=5, percent=80)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source schedule takes them."""
    return mixing.mixed_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with little padding."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express compression, tokenizing or the packing of windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
