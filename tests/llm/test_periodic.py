"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from larkspur.llm import oracles, periodic
from larkspur.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(w, min_length=6, min_periods=4):
    n, found = len(w), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_periods * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fast_runs(texts, **kw):
    offsets = np.cumsum([0, *map(len, texts)])
    flat = np.array([w for t in texts for w in t], np.int64)
    at, length, d = periodic.runs_of(flat, offsets, **kw)
    out = [[] for _ in texts]
    for a, n, q in zip(at.tolist(), length.tolist(), d.tolist(), strict=True):
        k = int(np.searchsorted(offsets, a, side="right")) - 1
        out[k].append((a - int(offsets[k]), n, q))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_equals_the_plain_search(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 8))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[: rng.randrange(1, 9 * len(unit))]
        texts.append(w)
    for kw in ({}, {"min_length": 2, "min_periods": 2}, {"min_length": 3, "min_periods": 3}):
        assert fast_runs(texts, **kw) == [plain_runs(t, **{"min_length": 6, "min_periods": 4, **kw}) for t in texts]


def test_words_of_famous_strings():
    fib = [0]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    square_free = [0]
    for _ in range(6):
        square_free = [y for x in square_free for y in {0: (0, 1, 2), 1: (0, 2), 2: (1,)}[x]]
    texts = [fib, b, square_free, [7] * 400, [1, 2] * 150 + [1], ([1] * 5 + [2]) * 40]
    for kw in ({}, {"min_length": 2, "min_periods": 2}):
        assert fast_runs(texts, **kw) == [plain_runs(t, **{"min_length": 6, "min_periods": 4, **kw}) for t in texts]


def planted(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def digests(i, w):
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_equals_the_plain_search_on_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_periodic"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(digests(i, planted(i, t)) for i, t in docs.items())
    assert sum(r.n_runs > 0 for r in got) > 5


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = "doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256"
    assert sorted(map(str, con.execute(f"SELECT {names} FROM ({oracles.PERIODIC})").fetchall())) == sorted(str(tuple(r)) for r in QUERIES["op12_periodic"](spark, SF).collect())


def test_odd_rows_and_long_texts(spark, odd_documents):
    from larkspur.llm.periodic import periodic_runs, run_digests

    rows = [(r.doc_id, r.text) for r in odd_documents.collect()] + [(70, "é \x0b\x0cb " * 9), (71, "a b " * 8), (70, "x " * 50_000 + "y")]
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, runs string, start int")
    got = sorted(map(str, map(tuple, run_digests(periodic_runs(docs)).collect())))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    few = [(i, t) for i, t in rows if len(t or "") < 1000]
    assert set(map(str, (digests(i, words(t)) for i, t in few))) <= set(got) and len(got) == len(rows)
    whole = [r for r in periodic_runs(docs).where("doc_id = 70").collect() if r.collapsed == "x y"]
    assert [tuple(x) for x in whole[0].runs] == [(0, 50_000, 1)]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_time_grows_with_the_words():
    """Strings that part few positions a length, or many, in time near n log n."""
    rng = np.random.default_rng(3)
    took = []
    for n in (20_000, 80_000):
        passage = rng.integers(0, 1 << 30, n // 8)
        texts = [np.zeros(n, int), rng.integers(0, 2, n), rng.integers(0, 5000, n), np.tile(rng.integers(0, 9, n // 5), 5), np.concatenate([passage, [-1], passage])]
        began = time.perf_counter()
        fast_runs([t.tolist() for t in texts])
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1
