"""Counts, pages, groups and ranks of list views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import clip
from larkspur.operators.folds import budget_step, folded


def plain_counts(items: DataFrame) -> DataFrame:
    """One row: all open, memo and ignored cards."""
    count = lambda v: F.count_if(F.col("is_verified") == v)
    return items.agg(count(0).alias("open_count"), count(1).alias("memo_count"), count(-1).alias("ignored_count"))


def group_count(items: DataFrame) -> DataFrame:
    """One row: distinct (subject, category) of cards with a subject plus the cards without one. Spaces alone are none."""
    subject = F.nullif(F.trim("subject"), F.lit(""))
    return items.agg((F.count_distinct(F.when(subject.isNotNull(), F.struct(subject.alias("s"), F.coalesce("category", F.lit("")).alias("c")))) + F.count_if(subject.isNull())).alias("group_count"))


def source_groups(items: DataFrame) -> DataFrame:
    """The distinct groups of all cards, one a row: combined groups are split at a comma and space."""
    return items.select(F.explode(F.split("source_group", ", ")).alias("source_group")).where("source_group <> ''").distinct()


def page(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return items.orderBy(F.desc("msg_time"), F.desc("id")).offset(offset).limit(limit)


def page_with_totals(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The page with the totals and the sorted source groups of the whole list on every row; an empty page still has one row
    of them. Groups are chats, so their set is small."""
    subject = F.nullif(F.trim("subject"), F.lit(""))
    totals = items.agg(
        F.count("*").alias("total_count"),
        (F.count_distinct(F.when(subject.isNotNull(), F.struct(subject.alias("s"), F.coalesce("category", F.lit("")).alias("c")))) + F.count_if(subject.isNull())).alias("group_count"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.split("source_group", ", "))), lambda g: g != ""))).alias("source_groups"),
    )
    return totals.join(page(items, limit, offset), F.lit(True), "left")


def with_more(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows with has_more: whether a further one exists. rows must be ordered."""
    some = rows.limit(limit + 1)
    n = some.agg((F.count("*") > limit).alias("has_more"))
    return some.limit(limit).crossJoin(n)


def newest_per_category(items: DataFrame, n: int, since: Column | str) -> DataFrame:
    """The newest n cards a category since a day; blank texts take a place and are dropped after."""
    recent = items.where(F.to_date("created_at") >= F.to_date(F.lit(since) if isinstance(since, str) else since))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("created_at"), "id"))
    return recent.withColumn("rank", rank).where((F.col("rank") <= n) & (F.trim(F.coalesce("source_quote", F.lit(""))) != ""))


def group_heads(items: DataFrame) -> DataFrame:
    """The newest card of each (subject, category); cards without a subject stand alone."""
    subject = F.nullif(F.trim("subject"), F.lit(""))
    group = F.coalesce(F.concat(F.lit("s:"), subject), F.concat(F.lit("i:"), F.col("id").cast("string")))
    w = Window.partitionBy(group, "category").orderBy(F.desc("msg_time"), F.desc("id"))
    size = F.count("*").over(Window.partitionBy(group, "category"))
    return items.withColumns({"rank": F.row_number().over(w), "size": size}).where("rank = 1").drop("rank")


def chat_heads(items: DataFrame) -> DataFrame:
    """The newest card of each chat; a card of several chats stands in each."""
    each = items.withColumn("chat", F.explode(F.split("source_group", ","))).withColumn("chat", F.trim("chat"))
    newest = F.max_by(F.col("id"), F.struct("msg_time", "id")).alias("id")
    return each.groupBy("chat").agg(newest, F.count("*").alias("size"))


def batches(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """rows with `batch`: fixed-size batches within each key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / n))


def heaviest_by_content(samples: DataFrame) -> DataFrame:
    """Of samples (content, category, weight, seq) with equal content the heaviest; ties go to the first."""
    best = F.max_by(F.struct("category", "weight", "seq"), F.struct("weight", (-F.col("seq")).alias("s"))).alias("b")
    return samples.groupBy("content").agg(best).select("content", "b.*")


def evidence(hits: DataFrame, most: int = 10, chars: int = 120) -> DataFrame:
    """hits (question, rrf, msg_time, content, ...) as numbered citations, best first, with a snippet."""
    n = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("rrf"), F.desc("msg_time"), "msg_id"))
    return hits.withColumn("n", n).where(F.col("n") <= most).withColumn("snippet", F.substring("content", 1, chars))


def sessions_by_name(sessions: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (sessions.where("enabled = 1") if enabled_only else sessions).orderBy("name", "source", "session_id")


def categories_by_id(categories: DataFrame, enabled: bool | None = None) -> DataFrame:
    rows = categories if enabled is None else categories.where(F.col("enabled") == int(enabled))
    return rows.orderBy("id")


def prompt_lines(messages: DataFrame, line_chars: int = 400, batch_chars: int = 4000) -> DataFrame:
    """Messages (batch_id, seq, source, session_id, content) with `line` and `kept`: which lines fit the prompt of their batch.

    Groups come in the order of their first message. A line over the budget that is left is skipped and later, shorter ones
    may still fit. Null contents are empty lines.
    """
    keys = ["batch_id", "source", "session_id"]
    first = messages.groupBy(*keys).agg(F.min("seq").alias("first__")).select(*[F.col(k).alias(f"{k}__k") for k in keys], "first__")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    lines = messages.join(first, on).withColumn("line", clip(F.col("content"), line_chars)).withColumn("size__", F.length(F.coalesce("line", F.lit(""))))
    taken = folded(lines, ["batch_id"], ["first__", "seq"], "size__", budget_step(batch_chars), "kept__", "count__")
    return taken.withColumn("kept", F.col("kept__") == 1).drop(*[f"{k}__k" for k in keys], "first__", "size__", "kept__", "count__")
