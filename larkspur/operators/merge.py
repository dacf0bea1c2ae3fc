"""Merging cards of one topic: ordered set reducers and the sequential resolution of merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.times import TIME_POINTS
from larkspur.scratch import written


def _ordered(c: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])


def merged_lines(c: str, order: str) -> Column:
    """Aggregate: the distinct non-blank lines of all texts, in order."""
    lines = F.flatten(F.transform(_ordered(c, order), lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.trim(x))))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def merged_key_info(c: str, order: str, separator: str = "; ") -> Column:
    """Aggregate: the distinct parts of all texts in order, equal in either case, as first written."""
    parts = F.flatten(F.transform(_ordered(c, order), lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), "[;；]"), lambda x: F.trim(x))))
    once = F.aggregate(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(once, separator)


def merged_list(c: str, order: str) -> Column:
    """Aggregate: the distinct elements of all lists, in order."""
    return F.array_distinct(F.flatten(F.transform(_ordered(c, order), lambda x: F.coalesce(x, F.array().cast("array<string>")))))


def merged_groups(c: str, order: str) -> Column:
    """Aggregate: the distinct names of all comma-joined groups, in order, joined again."""
    names = F.flatten(F.transform(_ordered(c, order), lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), ","), lambda x: F.trim(x))))
    return F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), ", ")


def sort_points(points: Column) -> Column:
    """Start before end, then by time."""
    order = lambda p: F.struct((p["type"] != "start").alias("a"), p["time"].alias("b"), p["label"].alias("c"), p.alias("p"))
    return F.transform(F.array_sort(F.transform(points, order)), lambda x: x["p"])


def merge_time_points(points: Column) -> tuple[Column, Column, Column]:
    """(start, end, extra) of all time points: the earliest start and end become primary, the rest is kept once a (type, time)."""
    of = lambda kind: F.array_min(F.transform(F.filter(points, lambda p: (p["type"] == kind) & (F.coalesce(p["time"], F.lit("")) != "")), lambda p: p["time"]))
    start, end = of("start"), of("end")
    valid = F.filter(points, lambda p: F.coalesce(p["time"], F.lit("")) != "")
    rest = F.filter(valid, lambda p: ~F.coalesce((p["type"] == "start") & (p["time"] == start), F.lit(False)) & ~F.coalesce((p["type"] == "end") & (p["time"] == end), F.lit(False)))
    once = F.aggregate(rest, F.array().cast(TIME_POINTS), lambda acc, p: F.when(F.exists(acc, lambda q: (q["type"] == p["type"]) & (q["time"] == p["time"])), acc).otherwise(F.concat(acc, F.array(p))))
    return start, end, sort_points(once)


def resolve_merges(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(survivor_id, absorbed_id) from candidates (source, session_id, category, new_id, new_time, cand_id, cand_time, rank,
    has_reminder) and verdicts (new_id, cand_id, same).

    New cards go in order of time within source, session and category. Candidates with a reminder are passed over after the rank
    limit, unknown verdicts too. A new card merges once at most; the earlier card survives; a card that is gone is no candidate any more.

    The order is resolved by rounds over whole tables: every new card takes its first candidate that no earlier card has taken
    away by the assumed outcome, and the outcome is the next assumption. A card depends on earlier cards only, so cards whose
    chain of dependence has at most r links are right after round r, and what reproduces itself is the result of the walk. Cards
    meet by their own ids, so a session with a third of all cards spreads over all tasks.
    """
    turn = F.struct("new_time", F.col("new_id").alias("turn_id"))
    group = ["source", "session_id", "category"]
    rows = candidates.where("NOT coalesce(has_reminder, false)").join(verdicts.where("same").select("new_id", "cand_id"), ["new_id", "cand_id"])
    keep_cand = F.col("cand_time") <= F.col("new_time")
    rows = rows.select(*group, "new_id", "cand_id", "rank", turn.alias("turn"), F.when(keep_cand, F.col("cand_id")).otherwise(F.col("new_id")).alias("keep"), F.when(keep_cand, F.col("new_id")).otherwise(F.col("cand_id")).alias("lose"))
    rows = written(rows, "merge-candidates")
    taken, seen = None, None
    while True:
        open_ = rows
        if taken is not None:
            gone = taken.groupBy("lose").agg(F.min("turn").alias("lost"))
            for who in ("new_id", "cand_id"):
                met = gone.select(F.col("lose").alias(who), F.col("lost").alias(f"lost_{who}"))
                open_ = open_.join(met, who, "left").where(F.col(f"lost_{who}").isNull() | (F.col(f"lost_{who}") >= F.col("turn")))
        first = open_.groupBy(*group, "new_id", "turn").agg(F.min(F.struct("rank", "keep", "lose")).alias("m"))
        taken = written(first.select("turn", "m.keep", "m.lose"), "merges")
        state = taken.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("keep", "lose")).alias("h")).first()
        if state == seen:
            return taken.select(F.col("keep").alias("survivor_id"), F.col("lose").alias("absorbed_id"))
        seen = state


def merged_cards(items: DataFrame, merges: DataFrame) -> DataFrame:
    """The rewritten survivors: earliest time, merged quotes, key info, groups and the subject of the earlier card if set."""
    parts = merges.select(F.col("survivor_id").alias("into"), F.col("absorbed_id").alias("id")).union(merges.select("survivor_id", "survivor_id")).distinct()
    rows = items.join(parts, "id").withColumn("order__", F.struct((F.col("id") != F.col("into")).alias("later"), "msg_time", "id"))
    return rows.groupBy(F.col("into").alias("id")).agg(
        F.min("msg_time").alias("msg_time"),
        F.min_by("title", "order__").alias("title"),
        F.coalesce(F.min_by("subject", F.when(F.coalesce("subject", F.lit("")) != "", F.col("order__"))), F.lit("")).alias("subject"),
        merged_lines("source_quote", "order__").alias("source_quote"),
        merged_key_info("key_info", "order__").alias("key_info"),
        merged_groups("source_group", "order__").alias("source_group"),
    )


def apply_merges(items: DataFrame, merges: DataFrame) -> DataFrame:
    """items after the merges: absorbed cards gone, survivors rewritten; all other columns are the survivor's own."""
    new = merged_cards(items, merges)
    columns = [c for c in new.columns if c != "id"]
    kept = items.join(merges.select(F.col("absorbed_id").alias("id")).distinct(), "id", "left_anti")
    fresh = new.select("id", *[F.col(c).alias(f"{c}__n") for c in columns], F.lit(True).alias("changed__"))
    rows = kept.join(fresh, "id", "left")
    return rows.select(*[F.when(F.col("changed__"), F.col(f"{c}__n")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in items.columns])


def stale_vectors(vectors: DataFrame, merges: DataFrame) -> DataFrame:
    """Vectors that still describe their card: those of survivors and absorbed cards are dropped."""
    touched = merges.select(F.col("survivor_id").alias("item_id")).union(merges.select("absorbed_id")).distinct()
    return vectors.join(touched, "item_id", "left_anti")
