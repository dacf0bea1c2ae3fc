"""Shared helpers of the training-data operators: scratch tables, distributed ranks, Arrow text slices."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import ship_package

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4 << 20
#: Spark's switch for removing a query's shuffle files at its end; what reads them again makes them again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a rank within one bucket should hold.
RANK_ROWS = 20_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where none is set, a folder of our own for local
    runs (tests) and an error on a cluster, whose machines share no temporary folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_larkspur_scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share when the session is built")
        path = sc._larkspur_scratch = "file://" + tempfile.mkdtemp(prefix="larkspur-scratch-")
    return path.rstrip("/")


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is written inside go when it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before else spark.conf.unset(FREE_SHUFFLES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    The table survives lost executors. `discard` and `discard_maker` remove it; what is left goes with spark.checkpoint.dir.
    """
    path = f"{scratch_dir(df.sparkSession)}/larkspur-{name}-{uuid.uuid4().hex}"
    with _freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    if _owner:
        _owned.setdefault(_owner[-1], []).append(path)
    return table


_owner: list[str] = []
_owned: dict[str, list[str]] = {}
_MADE_BY = "larkspur_made_by"


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Remove a table that `materialise` wrote and that nothing reads any more."""
    if path := getattr(table, "_scratch_path", None):
        _remove(table.sparkSession, path)


@contextmanager
def owned_tables(owner: str) -> Iterator[None]:
    """Tables written inside belong to `owner`, a name that no other call has; `discard_owned` removes them together."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def made_by(df: DataFrame, owner: str) -> DataFrame:
    """df with the owner of its scratch tables in its first column's metadata, which Parquet keeps."""
    first = df.schema.fields[0]
    return df.withMetadata(first.name, {**(first.metadata or {}), _MADE_BY: owner})


def discard_maker(docs: DataFrame) -> None:
    """Remove the scratch tables behind the result that docs was written from and read again, and no other call's. Nothing is
    removed where docs was not written: its plan still reads those tables."""
    for field in docs.schema.fields:
        paths = _owned.get((field.metadata or {}).get(_MADE_BY), [])
        if paths and not any(p.rsplit("/", 1)[-1] in f for f in docs.inputFiles() for p in paths):
            for path in _owned.pop(field.metadata[_MADE_BY]):
                _remove(docs.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, so extra columns of a caller never clash with ours."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each part has about `limit` bytes; at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def prefix_ranks(df: DataFrame, keys: list[str], order: list[str], bucket: Column, rank: str, weight: str | None = None) -> DataFrame:
    """Add `rank`: the number of rows (or the sum of `weight`) of the same keys that come before a row.

    `bucket` must grow with `order`. Rows are ranked inside (keys, bucket) and the totals of the buckets before are
    added, so a key with a third of all rows is spread over its buckets and no task gathers a whole key.
    """
    b, before, inner = (free_name(df, n) for n in ("bucket_", "before_", "inner_"))
    df = df.withColumn(b, bucket)
    one = F.col(weight) if weight else F.lit(1)
    totals = df.groupBy(*keys, b).agg(F.sum(one).cast("long").alias(before))
    # The small table: a row per key and bucket.
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    within = Window.partitionBy(*keys, b).orderBy(*order)
    if weight:
        local = F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    else:
        local = (F.row_number().over(within) - 1).cast("long")
    right = totals.select(*[F.col(k).alias(f"{k}__k") for k in keys], F.col(b).alias(f"{b}__k"), before)
    on = F.lit(True)
    for k in [*keys, b]:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    ranked = df.withColumn(inner, local).join(right, on, "left")
    drop = [b, before, inner, *[f"{k}__k" for k in [*keys, b]]]
    return ranked.withColumn(rank, F.col(inner) + F.col(before)).drop(*drop)
