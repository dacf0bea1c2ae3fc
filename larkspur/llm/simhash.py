"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it. Fingerprints that differ in
at most `distance` bits are linked. With the bits cut into `blocks` blocks, such a pair agrees on at least blocks - distance
whole blocks, so it meets under one of the keys that name a choice of that many blocks and their bits; six blocks and four
bits give fifteen keys of about 21 bits each. What meets is verified by the number of differing bits.

Equal fingerprints are one node, whatever the number of their texts. Under a key with few nodes every pair is verified,
array against shifted array, and only a spanning forest of the links leaves the task. A key with many nodes (a large group
of near copies, whose fingerprints lie close together) is dealt out: its nodes are linked with two pivots first, and what is
left outside the key's largest part so far meets all blocks of the key, block by block. Connected components of the links
give each document the smallest identifier that it can reach.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle; a null identifier can be in a component but is its identifier only where all are null;
rows that repeat an identifier are separate documents; extra columns are ignored; an empty table gives an empty result.
Texts are read whole; hashes are summed piece by piece, so a long text holds its words and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, materialise, text_slices
from larkspur.llm.components import connected_components

BITS = 64
BLOCKS = 6
DISTANCE = 4
SEED = 42
#: Nodes under one key that are verified in one task; a key with more is dealt out in blocks of this many.
HOT_NODES = 2048
#: Copies of one fingerprint that may meet in one task where a document is given its component.
HOT_COPIES = 256
#: Rows of numbers that may be broadcast; where there could be more, the bound of what counts as many is raised.
BROADCAST_ROWS = 500_000
#: Lots of a component's nodes where they meet its smallest identifier.
SALTS = 16
#: Hashes whose bits are counted at a time.
_PIECE = 1 << 16


def bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = np.array(hashes[at : at + _PIECE], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, k: int, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # ASCII only, both
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    if len(hashes) == 1:
        return hashes[0]
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = SEED) -> DataFrame:
    """doc_id, node (the fingerprint as a signed number) of each row of docs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = np.fromiter((fingerprint(t.as_py(), k, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, f"doc_id {kind}, node long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of blocks that a pair within the distance must agree on, as signed numbers."""
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("a pair needs a block without differing bits: distance < blocks <= 64")
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    masks = [sum(choice) for choice in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """nodes with a row for each key; two keys of one hash only mean that more is verified."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("node").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return nodes.withColumn("key", F.explode(keys))


def _forest(key: np.ndarray, node: np.ndarray, part: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs of parts that a link between nodes of one key joins, as a forest; the rows are sorted by key."""
    _, root = np.unique(part, return_inverse=True)
    names = np.zeros(len(part), np.int64)
    names[root] = part
    up = np.arange(len(names))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    links, step = [], 0
    left = np.arange(len(key))
    while True:
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left + step] == key[left]]
        if not len(left):
            return links
        other = left + step
        open_ = root[left] != root[other]
        x, y = left[open_], other[open_]
        near = np.bitwise_count(node[x] ^ node[y]) <= distance
        if near.any():
            for a, b in zip(root[x[near]].tolist(), root[y[near]].tolist(), strict=True):
                i, j = find(a), find(b)
                if i != j:
                    up[i] = j
                    links.append((int(names[a]), int(names[b])))
            while (up[up] != up).any():
                up = up[up]
            root = up[root]


def verified(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b) of parts linked by nodes that share a key: rows (key, node, part), dealt by key."""
    rows = rows.select("key", "node", "part").repartition("key").sortWithinPartitions("key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            key, node, part = (np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            held = [key[whole:], node[whole:], part[whole:]]
            links = _forest(key[:whole], node[:whole].view(np.uint64), part[:whole], distance)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], ["a", "b"])
        links = _forest(held[0], held[1].view(np.uint64), held[2], distance)
        yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], ["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def _pivot_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links of the nodes under large keys with two pivots of each: the one with most copies and one by a hash."""
    first, second = F.min(F.struct(-F.col("copies"), F.xxhash64("node"), "node")), F.min(F.struct(F.xxhash64("node", F.lit(1)), "node"))
    pivots = hot.groupBy("key").agg(first.alias("p"), second.alias("q")).select("key", F.explode(F.array("p.node", "q.node")).alias("pivot"))
    met = hot.select("key", "node").join(F.broadcast(pivots), "key")  # two rows a large key
    return met.where((F.col("node") != F.col("pivot")) & (F.bit_count(F.col("node").bitwiseXOR(F.col("pivot"))) <= distance)).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()


def _block_rows(hot: DataFrame, size: int) -> DataFrame:
    """Rows (key, node, part) of the pairs of blocks of large keys; two blocks of a key's largest part do not meet."""
    counts = hot.groupBy("key", "part").agg(F.count("*").alias("n"))
    plan = counts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(size)).cast("long")
    plan = plan.select("key", F.col("most.part").alias("main_part"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("all") - F.col("most.n")).alias("others")).where("others > 0")
    rows = hot.join(F.broadcast(plan), "key").withColumn("main", F.col("part") == F.col("main_part"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")))
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_other = F.transform(upto(F.col("others")), lambda j: F.when(F.col("main"), F.struct(F.lit(True).alias("cross"), j.alias("i"), F.col("own").alias("j"))).otherwise(F.struct(F.lit(False).alias("cross"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    with_main = F.transform(upto(F.col("mains")), lambda j: F.struct(F.lit(True).alias("cross"), F.col("own").alias("i"), j.alias("j")))
    pairs = F.when(F.col("main"), with_other).otherwise(F.concat(with_other, with_main))
    return rows.select("key", "node", "part", F.explode(pairs).alias("pair")).select(F.xxhash64("key", "pair.cross", "pair.i", "pair.j").alias("key"), "node", "part")


def node_labels(nodes: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(node, label) of the nodes (node, copies) that are linked with another: label is the smallest node of the component."""
    rows = keyed(nodes, block_masks(blocks, distance))
    # Of n rows at most n / bound keys have more than the bound.
    bound = max(HOT_NODES, nodes.count() * len(block_masks(blocks, distance)) // BROADCAST_ROWS)
    large = materialise(rows.groupBy("key").count().where(F.col("count") > bound).select("key"), "large-keys")
    if large.isEmpty():
        return connected_components(verified(rows.withColumn("part", F.col("node")), distance))
    few = verified(rows.join(F.broadcast(large), "key", "left_anti").withColumn("part", F.col("node")), distance)
    hot = materialise(rows.join(F.broadcast(large), "key"), "large-rows")
    parts = materialise(connected_components(few.union(_pivot_links(hot, distance))), "parts")
    placed = materialise(hot.join(parts, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part")), "placed")
    merged = connected_components(verified(_block_rows(placed, bound), distance)).select(F.col("node").alias("part"), F.col("label").alias("whole"))
    known = parts.select("node", F.col("label").alias("part")).join(merged, "part", "left").select("node", F.coalesce("whole", "part").alias("label"))
    alone = merged.join(parts.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("label"))
    labels = materialise(known.union(alone), "labels")
    for table in (hot, parts, placed):
        discard(table)
    return labels


def hex_digits(node: Column) -> Column:
    return F.lpad(F.lower(F.hex(node)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, blocks: int = BLOCKS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id for each row of docs."""
    signed = materialise(fingerprints(docs, id_col, text_col, k, seed), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one")
    nodes = materialise(signed.groupBy("node").agg(least, F.count("*").alias("copies")), "nodes")
    labels = node_labels(nodes.select("node", "copies"), blocks, distance)
    linked = nodes.join(labels, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    best = linked.groupBy("label").agg(F.min("one").alias("best")).withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    firsts = linked.join(best, ["label", "salt"]).select("node", "best")
    found = materialise(nodes.join(firsts, "node", "left").select("node", "copies", F.coalesce("best", "one").alias("first")), "firsts")
    # Of N documents at most BROADCAST_ROWS nodes have more than N / BROADCAST_ROWS copies each: those are broadcast.
    often = F.col("copies") > max(HOT_COPIES, signed.count() // BROADCAST_ROWS)
    hot, rest = F.broadcast(found.where(often).drop("copies")), found.where(~often).drop("copies")
    placed = signed.join(hot, "node").unionByName(signed.join(hot.select("node"), "node", "left_anti").join(rest, "node"))
    return placed.select("doc_id", hex_digits(F.col("node")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
