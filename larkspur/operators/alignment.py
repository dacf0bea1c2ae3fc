"""Whether the quote of a classified message is taken from that message or from another one of its batch.

The literal rule asks how much of a quote its own message covers and how much the best other one does. A cover is at most the
share of characters that two texts have in common, repeats counted, so a pair whose share stays within the margin below the
quote's own cover cannot change the verdict. Such pairs are not formed: a quote meets the messages of its batch by its rarest
characters only, as many as the bound needs. What the literal rule leaves open goes to the vectors.

Defined results: a quote without characters (null, or white space and punctuation only) is kept; an index that the batch does
not have covers nothing; in a batch of one message the quote needs a share of `floor` only; rows that repeat an index of
contents are messages of their own, and the best of them is the quote's.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import align_text, containment, cover
from larkspur.functions.vectors import cosine

MARGIN = 0.05
FLOOR = 0.3
#: Room for rounding: a pair is left out only where its bound is below the threshold by more than this many characters.
_SLACK = 1e-6


@F.pandas_udf(T.DoubleType())
def _cover_above(q: pd.Series, c: pd.Series, least: pd.Series) -> pd.Series:
    """The cover of q by c; null where the characters in common already say that it is at most `least` characters."""

    def one(a: str, b: str, n: float) -> float | None:
        if a not in b and (Counter(a) & Counter(b)).total() <= n - _SLACK:
            return None
        return cover(a, b)

    return pd.Series([one(*x) for x in zip(q, c, least, strict=True)], dtype="float64")


def _characters(rows: DataFrame, idx: str, column: str) -> DataFrame:
    return rows.select("batch_id", idx, F.explode(F.split(column, "")).alias("ch")).groupBy("batch_id", idx, "ch").agg(F.count("*").alias("n"))


def rare_characters(quotes: DataFrame, contents: DataFrame) -> DataFrame:
    """(batch_id, idx, ch): the rarest characters of each quote (batch_id, idx, q, least), so many that a message of the
    batch without any of them has at most `least` characters in common with it."""
    often = _characters(contents, "other", "c").groupBy("batch_id", "ch").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("batch_id", "idx").orderBy(F.coalesce("often", F.lit(0)), "ch")
    rest = F.sum("n").over(rare.rowsBetween(0, Window.unboundedFollowing))
    own = _characters(quotes, "idx", "q").join(often, ["batch_id", "ch"], "left").withColumn("rest", rest)
    return own.join(quotes.select("batch_id", "idx", "least"), ["batch_id", "idx"]).where(F.col("rest") + _SLACK > F.col("least")).select("batch_id", "idx", "ch")


def literal_verdicts(quotes: DataFrame, contents: DataFrame, margin: float = MARGIN, floor: float = FLOOR) -> DataFrame:
    """quotes (batch_id, idx, quote; one a key) against contents (batch_id, idx, content): batch_id, idx, own, other (the best
    cover by another message, where it can matter) and aligned: true, false, or null where neither leads by the margin."""
    q = quotes.select("batch_id", "idx", align_text("quote").alias("q"))
    c = contents.select("batch_id", F.col("idx").alias("other"), align_text("content").alias("c"))
    sizes = c.groupBy("batch_id").agg(F.count("*").alias("messages"))
    mine = q.join(c.withColumnRenamed("other", "idx"), ["batch_id", "idx"], "left").withColumn("own", containment("q", F.coalesce("c", F.lit(""))))
    mine = mine.groupBy("batch_id", "idx").agg(F.first("q").alias("q"), F.max("own").alias("own")).join(sizes, "batch_id", "left")
    open_ = mine.where("q <> '' AND messages > 1").withColumn("least", (F.col("own") - margin) * F.char_length("q"))
    met = rare_characters(open_.select("batch_id", "idx", "q", "least"), c)
    pairs = met.join(_characters(c, "other", "c").select("batch_id", "other", "ch"), ["batch_id", "ch"]).where("other <> idx").select("batch_id", "idx", "other").distinct()
    covers = pairs.join(open_, ["batch_id", "idx"]).join(c, ["batch_id", "other"]).select("batch_id", "idx", _cover_above("q", "c", "least").alias("cover"))
    best = covers.groupBy("batch_id", "idx").agg(F.max("cover").alias("other"))
    found = mine.join(best, ["batch_id", "idx"], "left").withColumn("other", F.coalesce("other", F.lit(0.0)))
    leads = F.when(F.col("own") >= F.col("other") + margin, True).when(F.col("other") >= F.col("own") + margin, False)
    alone = F.coalesce("messages", F.lit(0)) <= 1
    return found.select("batch_id", "idx", "own", "other", F.when(F.col("q") == "", True).when(alone, F.col("own") >= floor).otherwise(leads).alias("aligned"))


def semantic_verdicts(asked: DataFrame, quote_vectors: DataFrame, vectors: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(batch_id, idx, near) of the quotes asked for: whether the quote's vector is about as close to its own message's as to
    any other's of the batch. Quotes without a vector are not answered."""
    q = asked.select("batch_id", "idx").join(quote_vectors.select("batch_id", "idx", F.col("vec").alias("q_vec")), ["batch_id", "idx"])
    pairs = q.join(vectors.select("batch_id", F.col("idx").alias("other"), "vec"), "batch_id", "left").withColumn("sim", cosine(F.col("q_vec"), F.col("vec")))
    same: Column = F.col("other") == F.col("idx")
    sims = pairs.groupBy("batch_id", "idx").agg(F.coalesce(F.max(F.when(same, F.col("sim"))), F.lit(0.0)).alias("own"), F.coalesce(F.max(F.when(~same, F.col("sim"))), F.lit(0.0)).alias("rest"))
    return sims.select("batch_id", "idx", (F.col("own") >= F.col("rest") - margin).alias("near"))


def quote_alignment(quotes: DataFrame, contents: DataFrame, quote_vectors: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The literal verdicts with `keep`: quotes that are left open stay unless their vector (batch_id, idx, vec) is closer to
    another message of the batch; those that go are to be asked again."""
    found = literal_verdicts(quotes, contents)
    if quote_vectors is None or vectors is None:
        return found.withColumn("keep", F.coalesce("aligned", F.lit(True)))
    near = semantic_verdicts(found.where("aligned IS NULL"), quote_vectors, vectors)
    return found.join(near, ["batch_id", "idx"], "left").withColumn("keep", F.coalesce("aligned", "near", F.lit(True))).drop("near")
