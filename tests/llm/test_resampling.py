"""Importance resampling against SQL, a brute-force draw and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from larkspur.llm import oracles, resampling
from larkspur.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def features(text, top_n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, top_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, top_n=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in features(t, top_n)[1])
    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = features(text, top_n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = drawn[: percent * len(drawn) // 100]
    return sorted((str(r[:4]), next((k + 1 for k, d in enumerate(drawn) if d is r), None) or 0) for r in rows)


def rows_of(df):
    return sorted((str([r.doc_id, r.n_features, r.weight, r.score]), r["rank"] or 0) for r in df.collect())


@pytest.mark.parametrize("top_n", [1, 2])
def test_equals_brute_force(spark, top_n):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), top_n=top_n)
    assert rows_of(got) == brute(docs, target, top_n)


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted((str([int(x) for x in r[:4]]), 0 if r[4] is None else int(r[4])) for r in con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({oracles.RESAMPLING})").fetchall())
    assert rows_of(QUERIES["op11_resampling"](spark, SF)) == want


def test_odd_rows_ties_and_a_long_text(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()] + [(50, "word " * 300_000), *[(60, "a b " * 15)] * 9, (None, "x y z " * 9), (61, "ÀÉ Straße ﬁ 1a2b \x00 c\x7fd " * 5)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rank int, score int").repartition(5)
    target = spark.createDataFrame([("the quick a b",), (None,), ("",)], "text string")
    got = rows_of(resampling.resample(docs, target, percent=40))
    want = brute(rows, ["the quick a b"], percent=40)
    # Equal rows share their ranks in any order.
    assert got == sorted(want) and sorted(k for _, k in got if k) == list(range(1, max(k for _, k in got) + 1))
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert rows_of(resampling.resample(docs, target.limit(0))) == brute(rows, [])
