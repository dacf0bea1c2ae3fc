"""Near duplicates by a grouped prefix join on word-shingle sets.

Every document becomes its set of distinct hashed word shingles. A prefix is the part of the set that comes first in one
global order; shingles that a counting sketch saw often come last, so prefixes hold the rare ones. Any order gives right
results; the sketch (a fixed number of counters, whatever the input) only makes them cheaper.

1. Grouping: documents with the same size and the same prefix are collapsed into one group.
2. Filter: two documents that link share at least l shingles within prefixes that are l - 1 longer than the classic ones.
   A group with fewer than l prefix shingles that other groups have too can have no partner and goes.
3. Group pairs: each prefix shingle has a few pivots, the group among its holders that shares its prefix with most others
   and one by a hash. A group is paired with the pivots of its shingles that are near enough in size and that it shares l of them
   with, so pairs grow with the groups and not with the square of a bucket.
4. Expansion: the pairs become pairs of a pivot with each member (a distinct set) of the group, and each is verified in full.
   Components of these links hold nearly all of a cluster of near copies.
5. The rest, exactly: shingles whose holders lie in one component say no more. Members of different components that share
   a shingle of at most HOLDERS holders are counted pair by pair, and those that can share enough are verified. Two members
   without such a shingle need enough of the others each; these few are clustered by them, and of each cluster every block
   of members outside its largest component is verified against every block whose sizes can meet. A block pair emits a
   spanning forest of its links.
6. Connected components of all verified links give each document the smallest identifier that it can reach.

Shingles, and sets as members, are compared as 64-bit hashes. Defined results: null and empty texts have no shingles and
link with nothing; equal sets are one member; a null identifier can be in a component but is its identifier only where all
are null; rows that repeat an identifier are separate documents; identifiers can be of any type with an order; extra
columns are ignored, and kept by `drop_near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bytewords
from larkspur.llm.common import discard, free_name, materialise, prefix_ranks, text_slices
from larkspur.llm.components import connected_components

#: Counters of the sketch: 8 MB.
SKETCH = 1 << 20
#: Members in a verification block, and pairs of one pivot that are verified together; a larger cluster has at most SIDE
#: blocks a side, so that its rows are shuffled a bounded number of times, unless blocks would pass BLOCK_SHINGLES.
BLOCK = 128
SIDE = 64
BLOCK_SHINGLES = 1 << 22
#: Member ids that are broadcast at a time to fetch their texts, or to drop them, and the most such lots; texts are shuffled
#: only beyond both.
BROADCAST_MEMBERS = 500_000
BROADCAST_LOTS = 16
#: Postings of a lot of shingles, pairs of a lot of pivots, and the most lots of each: one lot is dealt out after the other, so
#: that a part of all is on disk at a time.
LOT_POSTINGS, POSTING_LOTS = 1 << 21, 4
LOT_PAIRS, PAIR_LOTS = 1 << 16, 16
#: Holders of a shingle whose pairs are counted one by one; what only more frequent shingles join is compared in blocks.
HOLDERS = 128
#: Copies of one set that may meet in one task where a document is given its component.
HOT_COPIES = 256
#: Extra prefix shingles, as one in so many of the set.
EXTRA = 20
#: Pivots of a shingle that a hash picks, beside the one that shares most of its prefix.
HASHED_PIVOTS = 1
#: Lots that members of one cluster and one size are ranked in.
LOTS = 64
#: Lots of a component's members where they meet its smallest identifier.
SALTS = 16


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, offsets of the rows)."""
    w = bytewords.words(column)
    h, n = w.hashes, len(column)
    cut = np.searchsorted(w.doc, np.arange(n + 1))
    x = np.zeros(0, np.uint64)
    if len(h) >= k:
        x = bytewords.mix64(h[k - 1 :].copy())
        for j in range(k - 2, -1, -1):
            x = bytewords.mix64(h[j : len(h) - k + 1 + j] + x)
    sets = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi - lo >= k:
            sets.append(np.unique(x[lo : hi - k + 1]))
        elif hi > lo:
            whole = np.array([0xA0761D6478BD642F + hi - lo], np.uint64)
            for j in range(hi - 1, lo - 1, -1):
                whole = bytewords.mix64(h[j : j + 1] + whole)
            sets.append(whole)
        else:
            sets.append(x[:0])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else x, offsets


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(11) & np.uint64(SKETCH - 1)).astype(np.int64)


def _set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle in each slot, over all documents: partial tables summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH, np.int64)
        for batch in text_slices(batches, "text"):
            table += np.bincount(_slot(shingle_sets(batch.column(0), k)[0]), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)])], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for one in batch.column(0):
                table += np.frombuffer(zlib.decompress(one.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)])], ["counts"])

    parts = materialise(docs.select("text").mapInArrow(count, "counts binary").repartition(16).mapInArrow(add, "counts binary"), "sketch")
    total = np.zeros(SKETCH, np.int64)
    for row in parts.toLocalIterator():  # sixteen rows
        total += np.frombuffer(zlib.decompress(bytes(row["counts"])), np.int64)
    discard(parts)
    return total


def _described(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, text_key, n, node (the set's hash), prefix of every document."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            flat, offsets = shingle_sets(batch.column("text"), k)
            often = counts.value[_slot(flat)]
            prefixes, nodes = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n, one = hi - lo, flat[lo:hi]
                length = n - -(-percent * n // 100) + max(1, n // EXTRA) if n else 0
                prefixes.append(one[np.lexsort((one, often[lo:hi]))[:length]])
                nodes.append(_set_id(one))
            starts = np.zeros(len(prefixes) + 1, np.int32)
            np.cumsum([len(p) for p in prefixes], out=starts[1:])
            prefix = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(prefixes).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(offsets)), pa.array(nodes, pa.int64()), prefix], ["doc_id", "text_key", "n", "node", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"doc_id {kind}, text_key long, n long, node long, prefix array<long>")


def _needed(n: Column, percent: int) -> Column:
    """Prefix shingles that a set of n must share with any partner."""
    return F.greatest(F.lit(1), F.floor(F.floor((n * percent + 99) / 100) / EXTRA))


def _pair_needed(a: Column, b: Column, percent: int) -> Column:
    """Prefix shingles that sets of a and b must share: the overlap of a link without what lies behind the prefix that ends
    first in the global order."""
    behind = lambda n: F.floor((n * percent + 99) / 100) - F.greatest(F.lit(1), F.floor(n / EXTRA))
    return F.greatest(F.lit(1), F.floor(((a + b) * percent + 99 + percent) / (100 + percent)) - F.greatest(behind(a), behind(b)))


def _near(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _able(postings: DataFrame, who: str, percent: int) -> DataFrame:
    """The postings of those who still share enough prefix shingles with others. Dealt by `who` once, for the count and the
    join alike."""
    dealt = postings.repartition(who)
    enough = dealt.groupBy(who).agg(F.count("*").alias("hits"), F.first("n").alias("n0")).where(F.col("hits") >= _needed(F.col("n0"), percent))
    return dealt.join(enough.select(who), who, "left_semi")


def _shared(postings: DataFrame, column: str) -> DataFrame:
    """The postings of shingles whose holders have more than one value of a column, with the number of holders. Dealt by
    shingle once, for the count and the join alike, which is why the count reads all columns; both stream, so a shingle that
    very many hold needs no more memory."""
    dealt = postings.drop("holders").repartition("token")
    rest = [F.min(c).alias(f"{c}_") for c in dealt.columns if c not in ("token", column)]
    several = dealt.groupBy("token").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("holders"), *rest).dropna().where("low < high")
    return dealt.join(several.select("token", "holders"), "token")


def _candidates(postings: DataFrame, who: str, column: str, percent: int, rounds: int, name: str, lots: int = 1) -> DataFrame:
    """What is left of the postings after some rounds of both filters; any number gives right results. The first round takes
    the shingles in lots."""
    parts = [materialise(_shared(postings.where(F.pmod("token", F.lit(lots)) == i), column), f"{name}-lot") for i in range(lots)]
    left = reduce(DataFrame.union, parts)
    for i in range(rounds):
        before, left = left, materialise(_able(_shared(left, column) if i else left, who, percent), name)
        for table in [before] if i else parts:
            discard(table)
    return left


def _pivot_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(pivot, g) pairs of groups that share enough shingles of which the one is a pivot, and are near in size."""
    central = postings.groupBy("g").agg((F.sum(F.log2("holders")) / F.first("n")).alias("share"))
    ranked = postings.join(central, "g")
    keys = [F.struct(-F.col("share"), F.xxhash64("g"), "g", "n"), *[F.struct(F.lit(0.0), F.xxhash64("g", F.lit(i)), "g", "n") for i in range(HASHED_PIVOTS)]]
    pivots = ranked.groupBy("token").agg(*[F.min(k).alias(f"p{i}") for i, k in enumerate(keys)])
    each = F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.g").alias("pivot"), F.col(f"p{i}.n").alias("pivot_n")) for i in range(len(keys))]))
    met = postings.join(pivots.select("token", each.alias("each")), "token").select("g", "n", F.explode("each").alias("p")).select("g", "n", "p.*")
    met = met.where((F.col("g") != F.col("pivot")) & _near(F.col("n"), F.col("pivot_n"), percent))
    return met.groupBy("pivot", "g").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where(F.col("hits") >= _needed(F.col("n"), percent)).select("pivot", "g")


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, node) that link: sets of a lot of nodes against their pivot's. The pairs, rows of three numbers, are
    broadcast and only the sets that they name are shuffled."""
    large = pairs.groupBy("pivot").count().where(F.col("count") > BLOCK)  # of N pairs at most N / BLOCK pivots
    lots = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1))
    dealt = pairs.join(F.broadcast(large), "pivot", "left").select("pivot", "node", F.pmod(F.xxhash64("node"), lots).alias("lot"))
    nodes = sets.join(F.broadcast(dealt), "node").select("pivot", "lot", "node", "shingles")
    centres = sets.join(F.broadcast(dealt.select("pivot", "lot").distinct()), F.col("node") == F.col("pivot")).select("pivot", "lot", "node", "shingles")
    rows = nodes.union(centres).withColumn("own", F.col("node") == F.col("pivot"))
    rows = rows.repartition("pivot", "lot").sortWithinPartitions("pivot", "lot", F.desc("own")).select("pivot", "node", "own", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            pivots, nodes, own = (batch.column(i).to_pylist() for i in range(3))
            links: list[tuple[int, int]] = []
            for i, blob in enumerate(batch.column(3)):
                one = np.frombuffer(blob.as_py(), np.uint64)
                if own[i]:
                    centre = one
                    continue
                at = np.searchsorted(centre, one)
                both = int((centre[np.minimum(at, len(centre) - 1)] == one).sum()) if len(centre) else 0
                if both and 100 * both >= percent * (len(one) + len(centre) - both):
                    links.append((pivots[i], nodes[i]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], ["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def _stars_by_lots(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> list[DataFrame]:
    """The links of the pairs, a table a lot of pivots."""
    lots = min(PAIR_LOTS, -(-pairs.count() // LOT_PAIRS)) or 1
    return [materialise(_star_links(pairs.where(F.pmod(F.xxhash64("pivot"), F.lit(lots)) == i), sets, percent), name) for i in range(lots)]


def _verified_links(owners: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, parts: np.ndarray, nodes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different parts; across the two sides where there are two."""
    m = len(owners)
    owner = np.repeat(np.arange(m), sizes)
    tokens = np.concatenate(owners)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.append(first, len(tokens)))
    distinct = tokens[first]
    parent: dict[int, int] = {p: p for p in parts.tolist()}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, two = [], bool((side != side[0]).any())
    for i in range(m):
        if two and side[i] != side[0]:
            continue
        at = np.searchsorted(distinct, owners[i])
        n = length[at]
        done = np.cumsum(n)
        idx = np.arange(done[-1]) + np.repeat(first[at] - (done - n), n)
        overlap = np.bincount(owner[idx], minlength=m)
        ok = (100 * overlap >= percent * (sizes[i] + sizes - overlap)) & (parts != parts[i])
        if two:
            ok &= side != side[i]
        else:
            ok[: i + 1] = False
        for j in np.flatnonzero(ok).tolist():
            a, b = find(int(parts[i])), find(int(parts[j]))
            if a != b:
                parent[a] = b
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _counted_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(pivot, node) pairs of members of different parts that share a shingle of few holders and, with all their shingles of
    many, can share enough."""
    frequent = F.col("holders") > HOLDERS
    many = postings.where(frequent).groupBy("node").agg(F.count("*").alias("many"))
    few = postings.where(~frequent)
    side = lambda s: few.select("token", *[F.col(c).alias(c + s) for c in ("node", "part", "n")])
    met = side("1").join(side("2"), "token").where((F.col("node1") < F.col("node2")) & (F.col("part1") != F.col("part2")) & _near(F.col("n1"), F.col("n2"), percent))
    pairs = met.groupBy("node1", "node2").agg(F.count("*").alias("hits"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    for s in ("1", "2"):
        pairs = pairs.join(many.select(F.col("node").alias("node" + s), F.col("many").alias("many" + s)), "node" + s, "left")
    enough = F.col("hits") + F.least(F.coalesce("many1", F.lit(0)), F.coalesce("many2", F.lit(0))) >= _pair_needed(F.col("n1"), F.col("n2"), percent)
    return pairs.where(enough).select(F.col("node1").alias("pivot"), F.col("node2").alias("node"))


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between the members (cluster, main, chunk, node, part, n, shingles): every block outside the cluster's
    largest part against every block of the cluster whose sizes can meet."""
    chunks = members.groupBy("cluster", "main", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"))
    left = chunks.where("NOT main").drop("main").withColumnRenamed("chunk", "i")
    right = chunks.select("cluster", "main", F.col("chunk").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("size").alias("size2"))
    meet = (F.col("high") * 100 >= F.col("low2") * percent) & (F.col("high2") * 100 >= F.col("low") * percent)
    pairs = left.join(right, "cluster").where(meet & (F.col("main") | (F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("size") > 1))))
    key = ["cluster", "main", "i", "j"]
    ends = F.when(F.col("main"), F.array(F.struct(F.lit(False).alias("main"), F.col("i").alias("chunk")), F.struct(F.lit(True).alias("main"), F.col("j").alias("chunk"))))
    ends = ends.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(False).alias("main"), F.col("i").alias("chunk")))).otherwise(F.array(F.struct(F.lit(False).alias("main"), F.col("i").alias("chunk")), F.struct(F.lit(False).alias("main"), F.col("j").alias("chunk"))))
    one = pairs.select("cluster", F.xxhash64(*key).alias("pair"), F.explode(ends).alias("end")).select("cluster", "pair", "end.main", "end.chunk")
    rows = members.join(one, ["cluster", "main", "chunk"]).select("pair", F.xxhash64("cluster", "main", "chunk").alias("side"), "node", "part", "shingles")
    rows = rows.repartition("pair").sortWithinPartitions("pair", "side")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            sets = [np.frombuffer(x[3], np.uint64) for x in held]
            side, nodes, parts = (np.array([x[c] for x in held], np.int64) for c in range(3))
            return _verified_links(sets, np.array([len(s) for s in sets]), side, parts, nodes, percent)

        for batch in batches:
            links = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if row[0] != key:
                    links += close()
                    key, held = row[0], []
                held.append(row[1:])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], ["a", "b"])
        links = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], ["a", "b"])

    return rows.select("pair", "side", "node", "part", "shingles").mapInArrow(verify, "a long, b long")


def _fetched(texts: DataFrame, wanted: DataFrame, k: int, repeated: bool) -> list[DataFrame]:
    """node, n, shingles of the wanted sets (doc_id, text_key of one document of each), from the texts again, a table a lot;
    `repeated` says that rows may agree in identifier and text."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            flat, offsets = shingle_sets(batch.column("text"), k)
            sets = [flat[lo:hi].tobytes() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(offsets)), pa.array(sets, pa.binary())], ["node", "n", "shingles"])

    same = (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    w = wanted.select(F.col("node"), F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    found = [texts.join(lot, same).select("node", "text").mapInArrow(fetch, "node long, n long, shingles binary") for lot in _lots(w, "w_key")]
    return [materialise(part.dropDuplicates(["node"]) if repeated else part, "shingles") for part in found]


def _lots(keys: DataFrame, by: str) -> list[DataFrame]:
    """The rows in lots that may be broadcast; rows that agree in `by` share a lot."""
    n = keys.count()
    if n > BROADCAST_LOTS * BROADCAST_MEMBERS:
        return [keys]
    lots = -(-n // max(1, BROADCAST_MEMBERS)) or 1
    return [F.broadcast(keys.where(F.pmod(F.xxhash64(by), F.lit(lots)) == i)) for i in range(lots)]


def _labelled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(described documents, (node, label) of the sets that link with another)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    whole = materialise(_described(texts, k, percent, _count_sketch(texts, k)).withColumn("prefix_key", F.xxhash64("prefix")), "described")
    groups = materialise(whole.where("n > 0").groupBy("n", "prefix_key").agg(F.min("node").alias("g"), F.first("prefix").alias("prefix"), (F.min("node") != F.max("node")).alias("several")), "groups")
    # From here on prefixes stand in the groups alone.
    described = materialise(whole.drop("prefix"), "nodes")
    discard(whole)
    full = described.where("n > 0")
    repeated = not full.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    classes = full.groupBy("n", "prefix_key", "node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"))
    size = groups.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 1
    every = groups.select("g", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    postings = _candidates(every, "g", "g", percent, 2, "postings", min(POSTING_LOTS, -(-size // LOT_POSTINGS)))
    pairs = _pivot_pairs(postings, percent)
    # Groups that can have a partner, or have several members, are expanded into their members.
    active = postings.select("g").union(groups.where("several").select("g")).distinct()
    members = materialise(classes.join(groups.select("n", "prefix_key", "g"), ["n", "prefix_key"]).join(active, "g").select("g", "node", "n", "one"), "members")
    fetched = _fetched(texts, members.select("node", "one.doc_id", "one.text_key"), k, repeated)
    sets = reduce(DataFrame.union, fetched)
    inner = members.where("node <> g").select(F.col("g").alias("pivot"), "node")
    star = members.select("g", "node").join(pairs, "g").select("pivot", "node").union(inner).distinct()
    star = materialise(star, "pairs")
    links = _stars_by_lots(star, sets, percent, "star-links")
    parts = materialise(connected_components(reduce(DataFrame.union, links)), "parts")
    for table in (star, postings, *links):
        discard(table)
    placed = members.join(parts, "node", "left").select("g", "node", "n", F.coalesce("label", "node").alias("part"))
    # Each member with its group's prefix: what still meets another part.
    prefixes = reduce(DataFrame.union, [groups.select("g", "prefix").join(lot, "g", "left_semi") for lot in _lots(members.select("g").distinct(), "g")])
    reach = materialise(placed.join(prefixes, "g").select("node", "part", F.col("n").cast("int").alias("n"), "prefix"), "reach")
    left = _candidates(reach.select("node", "part", "n", F.explode("prefix").alias("token")), "node", "part", percent, 1, "rest")
    discard(groups)
    discard(reach)
    few = materialise(_counted_pairs(left, percent), "few-pairs")
    few_links = _stars_by_lots(few, sets, percent, "few-links")
    discard(few)
    frequent = left.where(F.col("holders") > HOLDERS)
    enough = frequent.groupBy("node").agg(F.count("*").alias("many"), F.first("n").alias("n0")).where(F.col("many") >= _needed(F.col("n0"), percent))
    before, left = left, materialise(frequent.join(enough.select("node"), "node"), "frequent")
    discard(before)
    low = left.groupBy("token").agg(F.min("part").alias("low"))
    joined = left.select("token", "part").distinct().join(low, "token").where("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b"))
    clusters = connected_components(joined).select(F.col("node").alias("part"), F.col("label").alias("cluster"))
    crowd = left.select("node", "part", "n").distinct().join(clusters, "part")
    by_part = crowd.groupBy("cluster", "part").agg(F.count("*").alias("count"), F.max("n").alias("n"))
    main = by_part.groupBy("cluster").agg(F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("size"), F.max("n").alias("largest"))
    wide = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("size") / SIDE), F.floor(F.lit(BLOCK_SHINGLES) / F.col("largest"))))
    crowd = crowd.join(main, "cluster").select("cluster", "node", "part", "n", (F.col("most.part") == F.col("part")).alias("main"), wide.alias("wide"))
    # In order of size; members of one size in lots, so that a cluster of copies of about one length is no single window.
    lot = F.pmod(F.xxhash64("node"), F.lit(LOTS))
    ranked = prefix_ranks(crowd.withColumn("lot", lot), ["cluster", "main"], ["n", "lot", "node"], F.col("n") * LOTS + F.col("lot"), "rank").withColumn("chunk", F.floor(F.col("rank") / F.col("wide")))
    blocks = materialise(ranked.select("cluster", "main", "chunk", "node", "part").join(sets, "node"), "blocks")
    more = materialise(_block_links(blocks, percent).union(reduce(DataFrame.union, few_links)), "links")
    nodes_to_parts = more.join(parts.select(F.col("node").alias("a"), F.col("label").alias("pa")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("label").alias("pb")), "b", "left")
    merged = connected_components(nodes_to_parts.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))).select(F.col("node").alias("part"), F.col("label").alias("whole"))
    # Parts that merge, and the single members among them.
    known = parts.select("node", F.col("label").alias("part")).join(merged, "part", "left").select("node", F.coalesce("whole", "part").alias("label"))
    alone = merged.join(parts.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("label"))
    labels = materialise(known.union(alone), "labels")
    for table in (members, *fetched, left, *few_links, blocks, more, parts):
        discard(table)
    return described, labels


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; documents link at a Jaccard similarity of percent / 100."""
    described, labels = _labelled(docs, id_col, text_col, k, percent)
    return _with_component(described, labels).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_component(described: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with `first`, the struct of the smallest identifier of their component."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one")
    one = described.where("n > 0").groupBy("node").agg(least, F.count("*").alias("copies"))
    # Sets that link with no other are their own component; the rest meet their component's first in SALTS lots.
    linked = one.join(labels, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    best = linked.groupBy("label").agg(F.min("one").alias("best")).withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    firsts = linked.join(best, ["label", "salt"]).select("node", "best")
    found = materialise(one.join(firsts, "node", "left").select("node", "copies", F.coalesce("best", "one").alias("first")), "firsts")
    # Of N documents at most BROADCAST_MEMBERS sets have more than N / BROADCAST_MEMBERS copies each: those are broadcast,
    # so that copies of one text do not meet in one task. Documents without words have no set to meet.
    often = F.col("copies") > max(HOT_COPIES, described.count() // max(1, BROADCAST_MEMBERS))
    hot, rest = found.where(often).drop("copies"), found.where(~often).drop("copies")
    worded, hot = described.where("n > 0"), F.broadcast(hot)
    few = worded.join(hot.select("node"), "node", "left_anti").join(rest, "node")
    none = described.where("n = 0").withColumn("first", F.lit(None).cast(found.schema["first"].dataType))
    return worded.join(hot, "node").unionByName(few).unionByName(none)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest identifier (rows equal in identifier and text
    stay together), and every row without words."""
    described, labels = _labelled(docs, id_col, text_col, k, percent)
    name_id, name_key = free_name(docs, "gone_id"), free_name(docs, "gone_key")
    kept = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    gone = _with_component(described, labels).where((F.col("n") > 0) & (kept != F.col("first")))
    gone = materialise(gone.select(F.col("doc_id").alias(name_id), F.col("text_key").alias(name_key)).distinct(), "gone")
    same = F.col(id_col).eqNullSafe(F.col(name_id)) & (F.xxhash64(text_col) == F.col(name_key))
    return reduce(lambda left, lot: left.join(lot, same, "left_anti"), _lots(gone, name_key), docs)
