"""SimHash near duplicates against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from larkspur.llm import simhash
from larkspur.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), 42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    """The smallest label of each fingerprint's component, by all pairs."""
    v = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(v))
    while True:
        before = label.copy()
        for i in range(len(v)):
            near = np.bitwise_count(v ^ v[i]) <= distance
            label[near] = label[near].min()
        if (before == label).all():
            return {int(x): int(k) for x, k in zip(v, label, strict=True)}


def expected(rows, k, distance=4):
    prints = [plain_print(t, k) for _, t in rows]
    part = plain_components(prints, distance)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[part[f]] = min(i, least.get(part[f], i))
    return sorted(str((i, f"{f:016x}", least.get(part[f]))) for (i, _), f in zip(rows, prints, strict=True))


def rows_of(df):
    return sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_query_equals_all_pairs_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(rows, 4)
    assert rows_of(QUERIES["op13_simhash"](spark, SF)) == want
    assert len({w.split(", ")[2] for w in want}) < len(rows) - 20  # near copies are there to find


def test_masks_cover_every_close_pair():
    rng = random.Random(5)
    for blocks, distance in ((6, 4), (5, 4), (7, 4), (4, 1), (1, 0)):
        masks = simhash.block_masks(blocks, distance)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), distance))
            assert any(diff & m & (2**64 - 1) == 0 for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(4, 4)


@pytest.mark.parametrize("hot", [2048, 40, 6])
def test_clouds_of_fingerprints(spark, monkeypatch, hot):
    """Dense clouds, chains of small steps and lone fingerprints, with keys verified whole and dealt out in blocks."""
    monkeypatch.setattr(simhash, "HOT_NODES", hot)
    rng = random.Random(9)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 1, 2**63}
    for c in centres:
        prints |= {flip(c, rng.randrange(0, 9)) for _ in range(150)}
    x = centres[0]
    for _ in range(40):
        x = flip(x, 4)
        prints.add(x)
    want = plain_components(prints)
    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x, 1 + x % 3) for x in prints], "node long, copies long")
    labels = {r.node % 2**64: r.label for r in simhash.node_labels(nodes).collect()}
    got = {x: labels.get(x, x - 2**64 if x >> 63 else x) for x in prints}
    pairs = {(got[x], want[x]) for x in prints}
    assert len(pairs) == len(set(got.values())) == len(set(want.values()))


def test_odd_rows_copies_and_a_long_text(spark, odd_documents, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_COPIES", 3)
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()] + [(40 + i, "The same Text again and again") for i in range(9)] + [(None, "the same\ttext again and AGAIN"), (60, "one"), (61, "ÀÉ é"), (59, "ONE")]
    rows += [(70, "".join(f"w{i} " for i in range(150_000))), (71, "".join(f"w{i} " for i in range(150_000)) + "tail")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, key string")
    for k in (4, 5):
        assert rows_of(simhash.simhash_components(docs, k=k)) == expected(rows, k)
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id string, text string")
    assert {r.component_id for r in simhash.simhash_components(nameless).collect()} == {None}
