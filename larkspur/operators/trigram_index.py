"""A trigram index of chunks with positions: built and updated by segments, read by the trigrams of a question only.

Folder layout, all Parquet:
- `postings/segment=/bucket=`: gram, block, places, members. A gram is three folded code points in one number. A block is
  some whole chunks, about `BLOCK_POINTS` code points, with all their fields one after the other; `places` are where a gram begins
  in its block, as differences of one to five bytes. Tasks sort the rows of a bucket by gram, so that row groups are
  skipped by their bounds; the rows are written where they are made, none is shuffled. A block's one row under the bucket
  after the last and `OWN` holds its members: source, msg_id, grams (the chunk's length in trigrams over all fields) and
  start (its first place), so that a search needs no table of chunks.
- `chunks/segment=`: source, msg_id, grams of what the segment brought.
- `repeated/segment=`: source, msg_id that the segment brought more than once.
- `dead/segment=`: source, msg_id, dead_segment, grams of earlier rows that the segment replaced or removed.
- `manifest/segment=`: docs, grams of all live chunks after the segment. A segment counts once its manifest row is there; the
  next attempt overwrites what a failed one left.

A phrase of n characters is n - 2 trigrams in a row: each place of trigram k stands for the place k before it, and a place
that all trigrams share is a match. Phrases are counted block by block, so no question and no common trigram gathers in one
task. Scores are BM25 over all fields with a phrase as the term.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Standard BM25.
K1, B = 1.2, 0.75
FIELDS = ("content", "sender_name", "group_name")
BUCKETS = 64
KEY = ["source", "msg_id"]
#: Code points of a block; a longer chunk is a block by itself.
BLOCK_POINTS = 1 << 22
#: The gram of a block's row of members.
OWN = -1
#: So many repeated keys are sent to every task; more are joined by a shuffle.
MOST_SENT = 200_000


@cache
def _fold_table() -> np.ndarray:
    """Lower-case code points, one for one; beyond the table a code point is its own."""
    return np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x20000)], np.uint32)


def folded(text: str) -> np.ndarray:
    """The code points of a text, letters in lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _fold_table()
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points)


def trigrams(points: np.ndarray) -> np.ndarray:
    """The trigrams at each position as numbers; none in fewer than three code points."""
    p = points.astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:] if len(p) > 2 else p[:0]


def bucket_of(gram: int, buckets: int = BUCKETS) -> int:
    return (gram ^ gram >> 21 ^ gram >> 42) % buckets


def packed(at: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists of ascending places, each from `first` on, as bytes: seven bits of a difference each, the low ones first."""
    step = np.diff(at, prepend=0)
    step[first] = at[first]
    size = 1 + sum((step >= 1 << 7 * b).astype(np.int64) for b in range(1, 5))
    start = np.concatenate([[0], np.cumsum(size)])
    data = np.empty(start[-1], np.uint8)
    for b in range(int(size.max(initial=0))):
        longer = np.flatnonzero(size > b)
        data[start[longer] + b] = step[longer] >> 7 * b & 127 | (size[longer] > b + 1) << 7
    bounds = start[np.append(first, len(at))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def unpacked(data: bytes) -> np.ndarray:
    """The places of one list."""
    b = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], b[:-1] < 128]))
    length = np.diff(np.append(first, len(b)))
    part = np.arange(len(b)) - np.repeat(first, length)
    return np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << 7 * part, first))


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many code points, or of one chunk."""
    size = sum(pc.fill_null(pc.utf8_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in FIELDS)
    begin = points = 0
    for i, n in enumerate(size.tolist()):
        if points and points + n > most:
            yield batch.slice(begin, i - begin)
            begin, points = i, 0
        points += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _postings(chunks: DataFrame, buckets: int, most: int) -> DataFrame:
    """gram, bucket, block, places, members of chunks (source, msg_id, content, sender_name, group_name)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in _blocks(batch, most)):
            texts = [t or "" for row in zip(*(block.column(f).to_pylist() for f in FIELDS), strict=True) for t in row]
            length = np.array([len(t) for t in texts], np.int64)
            end = np.cumsum(length)
            points = folded("".join(texts))
            whole = np.ones(len(points), bool)  # places where a trigram lies within its text
            for before in (1, 2):
                whole[(end - before)[end >= before]] = False
            at = np.flatnonzero(whole)
            gram = trigrams(points)[at]
            order = np.argsort(gram, kind="stable")
            gram, at = gram[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else at
            number = uuid.uuid4().int >> 65
            grams = np.maximum(length - 2, 0).reshape(-1, len(FIELDS)).sum(1)
            start = (end - length).reshape(-1, len(FIELDS))[:, 0]
            members = pa.StructArray.from_arrays([*(block.column(c) for c in KEY), pa.array(grams), pa.array(start)], [*KEY, "grams", "start"])
            listed = pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)
            names = ["gram", "bucket", "block", "places", "members"]
            yield pa.RecordBatch.from_arrays([pa.array([OWN]), pa.array([buckets], pa.int32()), pa.array([number]), pa.nulls(1, pa.binary()), listed], names)
            if len(first):
                own = gram[first]
                bucket = ((own ^ own >> 21 ^ own >> 42) % buckets).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(bucket), pa.array(np.full(len(own), number)), packed(at, first), pa.nulls(len(own), listed.type)], names)

    return chunks.select(*KEY, *FIELDS).mapInArrow(cut, _postings_schema(chunks))


def _postings_schema(keyed: DataFrame) -> str:
    source, msg_id = (keyed.schema[c].dataType.simpleString() for c in KEY)
    return f"gram long, bucket int, block long, places binary, members array<struct<source: {source}, msg_id: {msg_id}, grams: bigint, start: bigint>>"


def _members(postings: DataFrame, buckets: int) -> DataFrame:
    """block, source, msg_id, grams, start of the chunks in a table of postings."""
    return postings.where((F.col("bucket") == buckets) & (F.col("gram") == OWN)).select("block", F.inline("members"))


class TrigramIndex:
    """The index in one folder. Several readers and one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, points: int = BLOCK_POINTS):
        self.spark, self.path, self.buckets, self.points = spark, path.rstrip("/"), buckets, points

    def _exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def manifest(self) -> list[tuple[int, int, int]]:
        """(segment, live chunks, their trigrams) after each segment, in order: a row a segment."""
        if not self._exists("manifest"):
            return []
        return sorted((r["segment"], r["docs"], r["grams"]) for r in self.spark.read.parquet(f"{self.path}/manifest").collect())

    def _table(self, name: str, segments: list[int]) -> DataFrame:
        """The rows of whole segments; those of a segment that never got its manifest row are left out."""
        paths = [p for s in segments if self._exists(p := f"{name}/segment={s}")]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{p}" for p in paths])

    def _alive(self, segments: list[int]) -> DataFrame:
        dead = self._table("dead", segments).select(*KEY, F.col("dead_segment").alias("segment"))
        return self._table("chunks", segments).join(dead, [*KEY, "segment"], "left_anti")

    def _newest(self, chunks: DataFrame, path: str) -> DataFrame:
        """One row of each key: the newest by msg_time, then the greatest content. Only rows of repeated keys are moved for it."""
        chunks.groupBy(*KEY).count().where("count > 1").select(F.struct(*KEY).alias("key__")).write.mode("overwrite").parquet(path)
        repeated = self.spark.read.parquet(path)
        n = repeated.count()
        if not n:
            return chunks
        listed = F.broadcast(repeated) if n <= MOST_SENT else repeated
        same = (F.col("source").eqNullSafe(F.col("key__.source"))) & (F.col("msg_id").eqNullSafe(F.col("key__.msg_id")))
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("msg_time"), F.desc("content")))
        several = chunks.join(listed, same, "left_semi").withColumn("rank__", rank).where("rank__ = 1").drop("rank__")
        return chunks.join(listed, same, "left_anti").unionByName(several)

    def append(self, chunks: DataFrame, remove: DataFrame | None = None) -> int:
        """Write chunks as a new segment; a chunk with a key that is there already replaces it, and keys of `remove` go. Of rows
        of one key in chunks the newest by msg_time counts. Gives the segment's number; doing it twice changes nothing."""
        known = self.manifest()
        segments = [s for s, _, _ in known]
        number = max(segments, default=0) + 1
        at = lambda name: f"{self.path}/{name}/segment={number}"
        fresh = self._newest(chunks, at("repeated"))
        made = _postings(fresh, self.buckets, self.points).sortWithinPartitions("bucket", "gram")
        made.write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        postings = self.spark.read.schema(_postings_schema(chunks)).parquet(at("postings"))
        _members(postings, self.buckets).select(*KEY, "grams").write.mode("overwrite").parquet(at("chunks"))
        own = self.spark.read.parquet(at("chunks"))
        gone = own.select(*KEY) if remove is None else own.select(*KEY).union(remove.select(*KEY)).distinct()
        if segments:
            dead = self._alive(segments).join(gone, KEY, "left_semi").select(*KEY, F.col("segment").cast("int").alias("dead_segment"), "grams")
        else:
            dead = own.where("false").select(*KEY, F.lit(0).alias("dead_segment"), "grams")
        dead.write.mode("overwrite").parquet(at("dead"))
        total = lambda t: t.agg(F.count("*").alias("n"), F.coalesce(F.sum("grams"), F.lit(0)).alias("g")).first()
        new, old = total(own), total(self.spark.read.parquet(at("dead")))
        before = known[-1] if known else (0, 0, 0)
        row = [(before[1] + new["n"] - old["n"], before[2] + new["g"] - old["g"])]
        self.spark.createDataFrame(row, "docs long, grams long").coalesce(1).write.mode("overwrite").parquet(at("manifest"))
        return number

    def compacted(self, path: str) -> TrigramIndex:
        """The live rows as the one segment of a new index at another path; the old one stays readable."""
        known = self.manifest()
        segments = [s for s, _, _ in known]
        new = TrigramIndex(self.spark, path, self.buckets, self.points)
        self._alive(segments).drop("segment").write.parquet(f"{new.path}/chunks/segment=1")
        self._alive(segments).where("false").select(*KEY, F.lit(0).alias("dead_segment"), "grams").write.parquet(f"{new.path}/dead/segment=1")
        live = self._live_postings(segments)
        live.repartition("bucket", F.pmod(F.col("gram"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{new.path}/postings/segment=1")
        self.spark.createDataFrame([known[-1][1:]], "docs long, grams long").coalesce(1).write.parquet(f"{new.path}/manifest/segment=1")
        return new

    def _live_postings(self, segments: list[int]) -> DataFrame:
        """The postings without the places of replaced and removed chunks, block by block."""
        postings = self._table("postings", segments)
        dead = self._table("dead", segments).select(*KEY, F.col("dead_segment").alias("segment"))
        owned = self._table("postings", segments).where((F.col("bucket") == self.buckets) & (F.col("gram") == OWN)).select("block", "segment", F.posexplode("members"))
        gone = owned.select("block", "segment", "pos", "col.source", "col.msg_id").join(dead, [*KEY, "segment"], "left_semi").select("block", "pos")
        names = ["gram", "bucket", "block", "places", "members"]

        def rest(rows: pa.Table, gone: pa.Table) -> pa.Table:
            if not gone.num_rows:
                return rows
            own = rows.filter(pc.equal(rows["gram"], OWN))
            members = own["members"].combine_chunks().flatten()
            dead = np.isin(np.arange(len(members)), gone["pos"].to_numpy())
            start = members.field("start").to_numpy()
            posts = rows.filter(pc.not_equal(rows["gram"], OWN))
            kept = [p[~dead[np.searchsorted(start, p, "right") - 1]] for p in map(unpacked, posts["places"].to_pylist())]
            size = np.array([len(p) for p in kept], np.int64)
            first = (np.cumsum(size) - size)[size > 0]
            posts = posts.filter(pa.array(size > 0))
            if len(first):
                posts = posts.set_column(names.index("places"), "places", packed(np.concatenate(kept), first))
            members = members.filter(pa.array(~dead))
            listed = pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)
            return pa.concat_tables([own.set_column(names.index("members"), "members", listed).cast(rows.schema), posts.cast(rows.schema)])

        return postings.select(*names).groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(rest, _postings_schema(dead))

    def phrase_counts(self, questions: list[str]) -> DataFrame:
        """question, term, source, msg_id, grams, tf: how often each term of each question occurs in each chunk that has it.
        Places count that overlap. Terms need three characters."""
        segments = [s for s, _, _ in self.manifest()]
        wanted = []
        for q in questions:
            for i, term in enumerate(q.split()):
                found = trigrams(folded(term)).tolist()
                if not found:
                    raise ValueError(f"a term of an index search needs three characters: {term!r}")
                wanted.append((q, i, found))
        grams = sorted({g for _, _, found in wanted for g in found})
        buckets = sorted({bucket_of(g, self.buckets) for g in grams})
        read = self._table("postings", segments).where(F.col("bucket").isin([*buckets, self.buckets]) & F.col("gram").isin([*grams, OWN]))
        dead = self._table("dead", segments).select(*KEY, F.col("dead_segment").alias("segment"))

        def matches(rows: pa.Table) -> pa.Table:
            own = pc.equal(rows["gram"], OWN)
            members = rows["members"].filter(own).combine_chunks().flatten()
            start = members.field("start").to_numpy()
            posts = rows.filter(pc.invert(own))
            places = dict(zip(posts["gram"].to_pylist(), map(unpacked, posts["places"].to_pylist()), strict=True))
            out = []
            for question, term, found in wanted:
                if any(g not in places for g in found):
                    continue
                at = None
                for k, g in sorted(enumerate(found), key=lambda x: len(places[x[1]])):  # the rarest first
                    begin = places[g] - k
                    at = begin if at is None else at[np.isin(at, begin, assume_unique=True)]
                which, tf = np.unique(np.searchsorted(start, at, "right") - 1, return_counts=True)
                one = members.take(pa.array(which))
                n = len(which)
                same = [pa.array([question] * n, pa.string()), pa.array(np.full(n, term, np.int32)), pa.array(np.full(n, rows["segment"][0].as_py(), np.int32))]
                out.append(pa.Table.from_arrays([*same, *(one.field(c) for c in (*KEY, "grams")), pa.array(tf.astype(np.int64))], columns))
            return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], kind) for kind in (pa.string(), pa.int32(), pa.int32(), *(members.field(c).type for c in KEY), pa.int64(), pa.int64())], columns)

        columns = ["question", "term", "segment", *KEY, "grams", "tf"]
        source, msg_id = (dead.schema[c].dataType.simpleString() for c in KEY)
        schema = f"question string, term int, segment int, source {source}, msg_id {msg_id}, grams long, tf long"
        met = read.select("gram", "block", "places", "members", "segment").groupBy("block").applyInArrow(matches, schema)
        return met.join(dead, [*KEY, "segment"], "left_anti").select("question", "term", *KEY, "grams", "tf")

    def search(self, questions: list[str], limit: int = 12) -> DataFrame:
        """question, source, msg_id, score, rank: of each question the chunks that have all its terms, best BM25 first; equal scores
        by key. A question without terms finds nothing."""
        asked = sorted({q for q in questions if q.split()})
        known = self.manifest()
        docs, total = known[-1][1:] if known else (0, 0)
        if not docs or not asked:
            empty = self._table("chunks", [s for s, _, _ in known]) if known else None
            kinds = [empty.schema[c].dataType.simpleString() if empty is not None else "string" for c in KEY]
            return self.spark.createDataFrame([], f"question string, source {kinds[0]}, msg_id {kinds[1]}, score double, rank int")
        counts = self.phrase_counts(asked)
        rarity = counts.groupBy("question", "term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        weights = F.broadcast(rarity.select("question", "term", idf.alias("idf")))  # a row a term asked
        tf = F.col("tf")
        one = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("grams") / F.lit(total / docs)))
        terms = self.spark.createDataFrame([(q, len(q.split())) for q in asked], "question string, terms int")
        scored = counts.join(weights, ["question", "term"]).groupBy("question", *KEY).agg(F.sum(one).alias("score"), F.count("*").alias("met"))
        every = scored.join(F.broadcast(terms), "question").where("met = terms")
        rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), *KEY))
        return every.withColumn("rank", rank).where(F.col("rank") <= limit).select("question", *KEY, "score", "rank")
