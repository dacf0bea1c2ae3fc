"""Benchmark cases built from cards, and checks over case files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.folds import folded, packing_step
from larkspur.operators.joins import adjacent_pairs, same_hash_pairs


def stable_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, n)


def batch_fingerprint(id_col: str = "msg_id") -> Column:
    """Aggregate: a short hash of the sorted ids as a JSON list."""
    ids = F.array_sort(F.collect_list(F.col(id_col).cast("string")))
    return F.substring(F.sha2(F.concat(F.lit('["'), F.array_join(ids, '", "'), F.lit('"]')), 256), 1, 16)


def pack_cases(cards: DataFrame, most: int = 8, chars: int = 2000) -> DataFrame:
    """cards (group, seq, content) with `case_no`: filled in order up to `most` messages and `chars` characters.

    A new case begins where a message would not fit. Null contents count as empty; a message over the limit is a case alone.
    """
    rows = cards.withColumn("size__", F.length(F.coalesce("content", F.lit(""))))
    placed = folded(rows, ["group"], ["seq"], "size__", packing_step(most, chars), "begins__", "cases__")
    return placed.withColumn("case_no", (F.col("cases__") - 1).cast("int")).drop("size__", "begins__", "cases__")


def dedup_cases(cards: DataFrame) -> DataFrame:
    """Pairs of equal texts (same) and of neighbours in a session and category with other texts (not the same)."""
    same = same_hash_pairs(cards, "content_hash", "id").select(F.col("first_id").alias("item_id"), F.col("later_id").alias("query_id"), F.lit(True).alias("same"))
    hashes = cards.select(F.col("id").alias("item_id"), F.col("content_hash").alias("h0"))
    near = adjacent_pairs(cards, ["session_id", "category"], ["msg_time", "id"], "id").select(F.col("head_id").alias("item_id"), F.col("tail_id").alias("query_id"), "content_hash").join(hashes, "item_id")
    other = near.where("content_hash <> h0").select("item_id", "query_id", F.lit(False).alias("same"))
    return same.unionByName(other).withColumn("case_id", stable_id(F.col("item_id").cast("string"), F.col("query_id").cast("string")))


def merge_cases(cards: DataFrame, window: int = 600) -> DataFrame:
    """Neighbouring cards of a session: to merge when subject and time agree."""
    w = Window.partitionBy("session_id", "category").orderBy("msg_time", "id")
    rows = cards.withColumns({"head": F.lag("id").over(w), "head_subject": F.lag("subject").over(w), "head_time": F.lag("msg_time").over(w)}).where("head IS NOT NULL")
    merge = (F.col("subject") != "") & (F.col("subject") == F.col("head_subject")) & (F.col("msg_time") - F.col("head_time") <= window)
    return rows.select(stable_id(F.col("head").cast("string"), F.col("id").cast("string")).alias("case_id"), F.col("head").alias("head_id"), F.col("id").alias("tail_id"), F.coalesce(merge, F.lit(False)).alias("merge"))


def title_cases(cards: DataFrame) -> DataFrame:
    """Categorised cards with their title as the expected one and their key info's keywords."""
    from larkspur.functions.text import split_keywords

    rows = cards.where("is_verified <> -1 AND coalesce(title, '') <> ''")
    return rows.select(stable_id(F.col("id").cast("string"), F.lit("title")).alias("case_id"), "source_quote", F.col("title").alias("expected_title"), split_keywords(F.col("key_info")).alias("keywords"))


def classify_cases(cards: DataFrame, most: int = 8, chars: int = 2000) -> DataFrame:
    """Packed cases of a session's cards with expected categories, one row a case."""
    rows = cards.where("is_verified <> -1 AND coalesce(trim(category), '') <> ''").select(F.col("session_id").alias("group"), F.col("id").alias("seq"), F.col("source_quote").alias("content"), "category")
    packed = pack_cases(rows, most, chars)
    expected = F.transform(F.array_sort(F.collect_list(F.struct("seq", "category"))), lambda x: x["category"])
    return packed.groupBy("group", "case_no").agg(F.count("*").alias("messages"), expected.alias("expected"), batch_fingerprint("seq").alias("fingerprint"))


def recorded_cases(decisions: DataFrame) -> DataFrame:
    """Observed decisions (query_id, candidate_id, verdict, ts) as cases: the newest verdict of a pair; unknown ones are no case."""
    rank = F.row_number().over(Window.partitionBy("query_id", "candidate_id").orderBy(F.desc("ts")))
    rows = decisions.where("verdict IS NOT NULL").withColumn("rank", rank).where("rank = 1")
    return rows.select(stable_id(F.col("query_id").cast("string"), F.col("candidate_id").cast("string")).alias("case_id"), "query_id", "candidate_id", F.col("verdict").alias("same"))


def merge_case_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cases of both sets; a new case replaces an old one of the same id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def item_conflicts(cases: DataFrame) -> DataFrame:
    """Item keys that stand for more than one card: (key, cards)."""
    return cases.select(F.explode("items").alias("i")).groupBy(F.col("i.msg_id").alias("key")).agg(F.count_distinct("i.content").alias("cards")).where("cards > 1")


def shared_item_keys(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.explode("items").alias("i")).groupBy(F.col("i.msg_id").alias("key")).agg(F.count_distinct("id").alias("cases")).where("cases > 1")


def conflicting_case_ids(cases: DataFrame) -> DataFrame:
    keyed = cases.select("id", F.explode("items").alias("i")).select("id", F.col("i.msg_id").alias("key"))
    return keyed.join(item_conflicts(cases).select("key"), "key", "left_semi").select("id").distinct()
