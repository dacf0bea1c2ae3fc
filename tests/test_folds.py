"""Folds over parts against a plain loop; hot groups, parts that cut groups anywhere."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.operators import cases, folds, lists


def rows_of(seed, hot):
    rng = random.Random(seed)
    out = [("hot" if rng.random() < hot else rng.choice(["a", "b", "c", None]), i, "x" * rng.choice([0, 1, 3, 7, 19, 40, 60])) for i in range(900)]
    rng.shuffle(out)
    return out


def packed(rows, most, chars):
    groups, out = defaultdict(list), {}
    for g, i, text in sorted(rows, key=lambda r: r[1]):
        groups[g].append((i, len(text)))
    for g, items in groups.items():
        case, n, used = 0, 0, 0
        for i, size in items:
            if n and (n >= most or used + size > chars):
                case, n, used = case + 1, 0, 0
            n, used = n + 1, used + size
            out[g, i] = case
    return out


@pytest.mark.parametrize(("parts", "hot", "most", "chars"), [(1, 0.3, 8, 50), (40, 0.4, 8, 50), (40, 1.0, 3, 1000), (48, 0.9, 5, 0), (64, 0.6, 1, 20)])
def test_packing(spark, parts, hot, most, chars):
    rows = rows_of(parts, hot)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.createDataFrame(rows, "group string, seq long, content string").withColumn("extra", F.lit(1))
        got = cases.pack_cases(frame, most, chars)
        assert got.columns == ["group", "seq", "content", "extra", "case_no"]
        assert {(r.group, r.seq): r.case_no for r in got.collect()} == packed(rows, most, chars)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_prompt_lines_of_a_hot_batch(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 else 1, i, "app", rng.randrange(6), "y" * rng.randrange(0, 90)) for i in range(600)]
    first, kept, used = {}, {}, {0: 0, 1: 0}
    for b, i, _, s, _ in rows:
        first.setdefault((b, s), i)
    for b, i, _, s, text in sorted(rows, key=lambda r: (r[0], first[r[0], r[3]], r[1])):
        kept[b, i] = used[b] + len(text) <= 700
        used[b] += len(text) * kept[b, i]
    got = lists.prompt_lines(spark.createDataFrame(rows, "batch_id int, seq long, source string, session_id int, content string").repartition(16), 100, 700)
    assert {(r.batch_id, r.seq): r.kept for r in got.collect()} == kept and 0 < sum(kept.values()) < len(kept)


def test_every_entry_meets_the_loop():
    rng = random.Random(1)
    for step, states in (folds.packing_step(4, 30), folds.budget_step(60)):
        sizes = [rng.randrange(0, 40) for _ in range(37)]
        every = folds._AllEntries(step, states)
        for n in sizes:
            every.put(n)
        every.merge()
        for entry in range(states):
            state, flags = entry, 0
            for n in sizes:
                state, one = step(state, n)
                flags += one
            assert (every.now[every.at[entry]], every.before[entry]) == (state, flags)


def test_empty(spark):
    assert cases.pack_cases(spark.createDataFrame([], "group string, seq long, content string")).count() == 0
