"""Importance resampling towards a target distribution over hashed word n-grams.

Every feature (a run of 1 to `top_n` words) falls into one of a fixed number of buckets. Higher-order functions make each
document's bucket array; the counts of the buckets over the corpus and over the target texts give each bucket a gain, the
rounded logarithm of its two smoothed shares; a document's weight is the sum of the gains over its array, one
`element_at` of a literal gain array each. Scoring therefore explodes, joins and shuffles nothing: the counting pass ships
the totals of the buckets after a partial aggregate, a fixed number of rows a task.

The weight plus Gumbel noise from a hash of the identifier is the score; the highest scores are a draw without
replacement in proportion to the weights. Scores are ranked by one range-partitioned sort: a row's rank is its place in its
partition plus the sizes of the partitions before, a number each.

Defined results: null texts have no features and weight 0; a null identifier is hashed as an empty one and comes last
among equal scores; rows that repeat an identifier are separate documents (the one with fewer features first among equal scores);
extra columns are ignored; without target texts or documents the smoothing alone decides; an empty table gives an empty
result. Texts of any length are read whole; one row's bucket array is the largest thing held.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialise

BUCKETS = 10_000
#: Words are runs of characters that are neither ASCII controls, space, punctuation, upper case (lowered before) nor DEL.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Bits of monotonically_increasing_id() that number the rows of a partition.
_PLACE_BITS = 33


def word_array(text: str) -> Column:
    """The words of the text with A-Z lowered; null gives none."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_array(words: str, top_n: int, buckets: int) -> Column:
    """The buckets of all runs of 1 to top_n consecutive words, from a column of words."""
    w = F.col(words)

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(w, lambda x: _bucket(x, buckets))
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: _bucket(F.array_join(F.slice(w, i, n), " "), buckets))

    return F.concat(*map(runs, range(1, top_n + 1))) if top_n > 1 else runs(1)


def bucket_counts(texts: DataFrame, text_col: str, top_n: int, buckets: int) -> list[int]:
    """How many features of all texts fall into each bucket. Only the totals of a task shuffle, and `buckets` rows come back."""
    words = texts.select(word_array(text_col).alias("words"))
    found = words.select(F.explode(bucket_array("words", top_n, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    counts = [0] * buckets
    for row in found.toLocalIterator():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of target share over corpus share) of each bucket, both smoothed by one count a bucket."""
    all_s, all_t, size = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_s + size) / (float(s + 1) * float(all_t + size)))) for s, t in zip(corpus, target, strict=True)]


def literal_longs(values: list[int]) -> Column:
    """The numbers as an array literal; written as one string, which the optimizer folds into the array once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def gumbel_score(id_col: str, weight: Column, seed: int) -> Column:
    """weight + floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:identifier)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored_documents(docs: DataFrame, gains: list[int], id_col: str, text_col: str, top_n: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one narrow pass over the texts."""
    table, buckets = literal_longs(gains), len(gains)
    rows = docs.select(F.col(id_col).alias("doc_id"), word_array(text_col).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), bucket_array("words", top_n, buckets).alias("found"))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", gumbel_score("doc_id", F.col("weight"), seed))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", top_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row per row of docs: doc_id, n_features, weight, score, rank; rank counts the floor(percent * N / 100) drawn of the N
    documents with at least min_words words from the highest score down and is null for the others."""
    gains = bucket_gains(bucket_counts(docs, text_col, top_n, buckets), bucket_counts(target, target_col, top_n, buckets))
    scored = scored_documents(docs, gains, id_col, text_col, top_n, seed).withColumn("able", F.col("n_words") >= min_words).drop("n_words")
    scored = materialise(scored, "scored")  # numbers only; the sort samples its input and then reads it, so the texts are not scored twice
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The partition of a sorted row and its place there, in one number.
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "resampled")
    part = F.shiftright("place", _PLACE_BITS).cast("int")
    sizes = {r["part"]: r for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect()}  # a row a partition
    before, starts = 0, []
    for p in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes[p]["n"] if p in sizes else 0
    drawn = percent * sum(r["able"] for r in sizes.values()) // 100
    rank = F.element_at(literal_longs(starts), part + 1) + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).cast("long").alias("rank"))
