"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally so that equal texts are
adjacent, and neighbours are compared in full; of equal texts the row with the smallest identifier stays.

The sort key is (first 64 code points, SHA-256, whole normalised text, identifier). The splitters leave out the whole
text, so the sample that the driver holds is bounded by about 150 bytes a splitter however long the texts are, and a
group of copies larger than a partition is split between partitions by its identifiers. Runs that touch a partition's
edge are reconciled through at most two rows a partition.

Defined results: null text counts as the empty text; null identifiers come last and never win against a known one; rows
repeated with the same identifier are one group of which one row stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import free_name, materialise, text_slices

#: Every run of two or more white-space characters, and every single one that is not a space already.
_FOLD = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: str):
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _FOLD, " ")


def _content_sorted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the helper columns norm, sha, head and sorted so that equal texts are adjacent."""
    names = {n: free_name(docs, n) for n in ("norm_", "sha_", "head_")}
    norm, sha, head = names.values()
    keyed = docs.withColumn(norm, normalised(text_col)).withColumn(sha, F.sha2(norm, 256)).withColumn(head, F.substring(norm, 1, 64))
    who = F.col(id_col).asc_nulls_last()
    return keyed.repartitionByRange(head, sha, who).sortWithinPartitions(head, sha, norm, who), names


def _starts(text: pa.Array, previous: str | None) -> np.ndarray:
    """Where a text differs from its neighbour before it, compared in full."""
    change = np.ones(len(text), bool)
    change[0] = previous is None or text[0].as_py() != previous
    if len(text) > 1:
        change[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, norm, sha) in content order -> a row per input row with its run's first id and length."""
    part = TaskContext.get().partitionId()
    open_ids: list[pa.Array] = []
    open_text, open_sha, closed = None, None, 0
    names = ["doc_id", "keep_id", "group_size", "is_head", "text_sha256", "edge", "edge_text", "part"]

    def out(ids: pa.Array, first: np.ndarray, length: np.ndarray, sha: pa.Array, edge_text: str | None) -> pa.RecordBatch:
        run = np.repeat(np.arange(len(first)), length)
        head = np.zeros(len(ids), bool)
        head[first] = True
        edge = edge_text is not None
        texts = pa.array([edge_text] + [None] * (len(ids) - 1), pa.string()) if edge else pa.nulls(len(ids), pa.string())
        cols = [ids, ids.take(pa.array(first[run])), pa.array(length[run]), pa.array(head), sha, pa.array(np.full(len(ids), edge)), texts, pa.array(np.full(len(ids), part, np.int32))]
        return pa.RecordBatch.from_arrays(cols, names)

    def close(edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(open_ids)
        sha = pa.array([open_sha], pa.string()).take(pa.array(np.zeros(len(ids), np.int64)))
        return out(ids, np.zeros(1, np.int64), np.array([len(ids)]), sha, open_text if edge else None)

    for batch in batches:
        ids, text, sha = batch.columns
        if not len(ids):
            continue
        starts = _starts(text, open_text)
        if not len(starts):
            open_ids.append(ids)
            continue
        if open_ids:
            if starts[0]:
                open_ids.append(ids.slice(0, int(starts[0])))
            yield close(edge=closed == 0)
            closed += 1
        elif len(starts) > 1:  # the partition's first run may go on in the partition before
            open_ids, open_text, open_sha = [ids.slice(0, int(starts[1]))], text[0].as_py(), sha[0].as_py()
            yield close(edge=True)
            closed += 1
            starts = starts[1:]
        if len(starts) > 1:
            lo, hi = int(starts[0]), int(starts[-1])
            yield out(ids.slice(lo, hi - lo), starts[:-1] - lo, np.diff(starts), sha.slice(lo, hi - lo), None)
            closed += len(starts) - 1
        last = int(starts[-1])
        open_ids, open_text, open_sha = [ids.slice(last)], text[last].as_py(), sha[last].as_py()
    if open_ids:
        yield close(edge=True)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered, names = _content_sorted(narrow, "doc_id", "text")
    id_type = narrow.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("keep_id", id_type)]).add("group_size", "long").add("is_head", "boolean").add("text_sha256", "string").add("edge", "boolean").add("edge_text", "string").add("part", "integer")
    rows = materialise(ordered.select("doc_id", names["norm_"], names["sha_"]).mapInArrow(_runs, schema), "exact-runs")
    edges = (
        rows.where(F.col("edge_text").isNotNull())
        .groupBy("edge_text")
        .agg(F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"), F.min("part").alias("first_part"), F.count("*").alias("n"), F.first("text_sha256").alias("edge_sha"))
        .where("n > 1")
        .drop("edge_text", "n")
    )
    # At most one row for each pair of neighbouring partitions.
    joined = rows.join(F.broadcast(edges), F.col("edge") & (F.col("text_sha256") == F.col("edge_sha")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("edge_sha").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("is_head") & (F.col("edge_sha").isNull() | (F.col("part") == F.col("first_part")))).alias("kept"),
        "text_sha256",
    )


def _heads(batches: Iterator[pa.RecordBatch], norm_name: str, edge_name: str, part_name: str) -> Iterator[pa.RecordBatch]:
    """Rows in content order, their normalised text last -> the first row of each run; the partition's first is marked.

    Rows are copied out a few megabytes at a time, and what a worker's earlier tasks left in its pool goes first."""
    part = TaskContext.get().partitionId()
    previous, first = None, True
    pa.default_memory_pool().release_unused()
    for batch in text_slices(batches, norm_name):
        text = batch.column(batch.num_columns - 1)
        starts = _starts(text, previous)
        previous = text[len(text) - 1].as_py()
        if len(starts):
            kept = batch.take(pa.array(starts))
            edge = np.zeros(len(starts), bool)
            edge[0], first = first, False
            cols = [*kept.columns[:-1], pa.array(edge), pa.array(np.full(len(starts), part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*kept.schema.names[:-1], edge_name, part_name])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the smallest identifier.

    The first run of a partition may continue an earlier partition's last run. Heads whose digest a partition's first head
    has, few in all, are compared in full by a shuffle; what is broadcast is a digest and a number for each partition.
    """
    ordered, names = _content_sorted(docs, id_col, text_col)
    norm, sha, edge, part = names["norm_"], names["sha_"], free_name(docs, "edge_"), free_name(docs, "part_")
    schema = T.StructType([*docs.schema.fields, T.StructField(sha, T.StringType()), T.StructField(edge, T.BooleanType()), T.StructField(part, T.IntegerType())])
    heads = materialise(ordered.select(*docs.columns, sha, norm).mapInArrow(lambda b: _heads(b, norm, edge, part), schema), "exact-heads")
    digests = F.broadcast(heads.where(F.col(edge)).select(sha).distinct())
    met = heads.join(digests, sha, "left_semi").select(F.col(sha).alias("sha"), normalised(text_col).alias("text"), F.col(part).alias("at"))
    began = met.groupBy("sha", "text").agg(F.min("at").alias("first"), F.collect_set("at").alias("all_at"))
    again = began.select(F.col("sha").alias("sha_k"), "first", F.explode("all_at").alias("at_k")).where("at_k > first").drop("first")
    lost = F.col(edge) & (F.col(sha) == F.col("sha_k")) & (F.col(part) == F.col("at_k"))
    return heads.join(F.broadcast(again), lost, "left_anti").select(*docs.columns)
