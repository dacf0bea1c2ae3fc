"""Quote alignment against the pairwise rule, written out in Python."""

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from larkspur.operators import alignment
from larkspur.plans import messages

NOISE = re.compile(r"[\s，。；：、,.!?！？（）()【】\[\]\"'《》“”‘’「」『』]")


def covered(q, c):
    if not q or (c and q in c):
        return 1.0
    return sum(b.size for b in SequenceMatcher(None, q, c).get_matching_blocks()) / len(q) if c else 0.0


def pairwise(quotes, contents):
    """{(batch, idx): (own, verdict)} of every quote against every message of its batch."""
    batches = defaultdict(list)
    for b, i, c in contents:
        batches[b].append((i, NOISE.sub("", c or "")))
    out = {}
    for b, i, quote in quotes:
        q, rows = NOISE.sub("", quote or ""), batches[b]
        own = max((covered(q, c) for j, c in rows if j == i), default=1.0 if not q else 0.0)
        other = max((covered(q, c) for j, c in rows if j != i), default=0.0)
        if not q:
            verdict = True
        elif len(rows) <= 1:
            verdict = own >= 0.3
        else:
            verdict = True if own >= other + 0.05 else False if other >= own + 0.05 else None
        out[b, i] = (own, verdict)
    return out


def check(got, want):
    assert {k: v for k, (_, v) in got.items()} == {k: v for k, (_, v) in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_random_batches(spark):
    rng = random.Random(7)
    contents, quotes = [], []
    for b in range(30):
        size = rng.choice([1, 2, 9])
        texts = ["".join(rng.choice("abcdef 讲座，在周三") for _ in range(rng.randrange(0, 40))) for _ in range(size)]
        texts[-1] += texts[0][:20]
        contents += [(b, i, None if not t else t) for i, t in enumerate(texts)]
        for i in range(size):
            t = rng.choice([texts[i], texts[rng.randrange(size)]])
            cut = t[2 : 2 + rng.randrange(0, 15)]
            quotes.append((b, i, rng.choice([cut, cut[::-1], cut + "xyz", None, "　\x1f 。"])))
        quotes.append((b, 99, "abc"))
    got = alignment.literal_verdicts(spark.createDataFrame(quotes, "batch_id int, idx int, quote string"), spark.createDataFrame(contents, "batch_id int, idx int, content string"))
    check({(r.batch_id, r.idx): (r.own, r.aligned) for r in got.collect()}, pairwise(quotes, contents))


def test_query(spark, sf):
    quotes, contents = (df.collect() for df in messages.turn_quotes(spark, sf))
    want = pairwise(quotes, contents)
    got = {(r.batch_id, r.idx): (r.own, r.aligned) for r in messages.quote_alignment(spark, sf).collect()}
    check(got, want)
    assert {True, False} <= {v for _, v in want.values()}


def test_pairs_that_cannot_matter_are_not_formed(spark):
    contents = spark.createDataFrame([(0, i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} the same words") for i in range(200)], "batch_id int, idx int, content string")
    quotes = contents.select("batch_id", "idx", alignment.align_text("content").alias("q"), (F.lit(0.95) * F.char_length(alignment.align_text("content"))).alias("least"))
    rare = alignment.rare_characters(quotes, contents.select("batch_id", F.col("idx").alias("other"), alignment.align_text("content").alias("c")))
    assert rare.count() == rare.where("ch > '一' OR ch = '一'").count() == 200


def test_vectors_decide_what_is_open(spark):
    contents = spark.createDataFrame([(0, 0, "abcd"), (0, 1, "abcd"), (0, 2, "wxyz")], "batch_id int, idx int, content string")
    quotes = spark.createDataFrame([(0, 0, "abc"), (0, 1, "abc"), (0, 2, "abc")], "batch_id int, idx int, quote string")
    vectors = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (0, 2, [1.0, 1.0])], "batch_id int, idx int, vec array<double>")
    near = spark.createDataFrame([(0, 0, [1.0, 0.1]), (0, 1, [1.0, 0.1])], "batch_id int, idx int, vec array<double>")
    kept = {r.idx: (r.aligned, r.keep) for r in alignment.quote_alignment(quotes, contents, near, vectors).collect()}
    assert kept == {0: (None, True), 1: (None, False), 2: (False, False)}
    assert {r.idx: r.keep for r in alignment.quote_alignment(quotes, contents).collect()} == {0: True, 1: True, 2: False}


def test_empty(spark):
    empty = "batch_id int, idx int, {} string"
    assert alignment.quote_alignment(spark.createDataFrame([], empty.format("quote")), spark.createDataFrame([], empty.format("content"))).count() == 0
