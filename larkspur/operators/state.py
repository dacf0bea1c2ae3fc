"""Mutations as rewrites: plain Parquet has no updates, so each returns the new table, or appends to a change log whose
newest entry is the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows to append: those whose key the table lacks, once each."""
    return rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: list[str], keep_if_blank: tuple[str, ...] = ()) -> DataFrame:
    """The table after replacing `update` columns by those of rows, and adding new rows.

    Other columns keep their old values; a column in keep_if_blank also does where the new value is blank.
    """
    new = rows.dropDuplicates(key).select(*[F.col(c).alias(f"{c}__n") for c in rows.columns], F.lit(True).alias("new__"))
    on = [table[k] == new[f"{k}__n"] for k in key]
    joined = table.withColumn("old__", F.lit(True)).join(new, on, "full_outer")
    out = []
    for c in table.columns:
        if c in key:
            out.append(F.coalesce(c, f"{c}__n").alias(c))
        elif f"{c}__n" not in joined.columns:
            out.append(F.col(c))
        elif c in keep_if_blank:
            out.append(F.coalesce(F.nullif(f"{c}__n", F.lit("")), c, f"{c}__n").alias(c))
        elif c in update:
            out.append(F.when(F.col("new__"), F.col(f"{c}__n")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("old__"), F.col(c)).otherwise(F.col(f"{c}__n")).alias(c))
    return joined.select(*out)


def upsert_contacts(table: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(table, rows, ["source", "sender_id"], ["display_name"])


def upsert_sessions(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Names, kinds and activity are refreshed; enabled and last_poll_ts stay as they are."""
    return upsert(table, rows, ["source", "session_id"], ["name", "is_group", "is_official", "last_seen", "last_active"])


def upsert_chunks(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Indexed messages are replaced; a card link stays where the new one is blank."""
    return upsert(table, rows, ["source", "msg_id"], ["session_id", "group_name", "sender_name", "msg_time", "content"], ("item_id",))


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest entry of each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*").select(*log.columns)


def current(items: DataFrame, log: DataFrame, column: str, order: list[str]) -> DataFrame:
    """items with `column` as the newest entry of a change log (id, <column>, ...) says."""
    new = latest(log, ["id"], order).select("id", F.col(column).alias("now__"), F.lit(True).alias("set__"))
    return items.join(new, "id", "left").withColumn(column, F.when(F.col("set__"), F.col("now__")).otherwise(F.col(column))).select(*items.columns)


def delete_items(items: DataFrame, raw: DataFrame, vectors: DataFrame, ids: DataFrame, keep_raw: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, raw, vectors) after deleting cards with their messages and vectors; processed marks stay."""
    gone = items.join(ids.select("id"), "id", "left_semi")
    key = gone.select("source", F.col("source_msg_id").alias("msg_id"))
    return (
        items.join(ids.select("id"), "id", "left_anti"),
        raw if keep_raw else raw.join(key, ["source", "msg_id"], "left_anti"),
        vectors.join(ids.select(F.col("id").alias("item_id")), "item_id", "left_anti"),
    )


def purge_ignored(items: DataFrame, hours: int, now: Column) -> DataFrame:
    """ids of ignored cards whose verdict is older than some hours; times compare as ISO text."""
    limit = F.date_format(now - F.make_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss")
    return items.where((F.col("is_verified") == -1) & F.col("verified_at").isNotNull() & (F.col("verified_at") < limit)).select("id")


def recategorize(items: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, log entries) after new categories (id, new_category); only real changes are logged."""
    joined = items.join(changes.select("id", "new_category"), "id", "left")
    log = joined.where(F.col("new_category").isNotNull() & ~F.col("new_category").eqNullSafe(F.col("category"))).select(
        F.col("id").alias("item_id"), "source", "source_msg_id", F.col("category").alias("category_before"), F.col("new_category").alias("category_after"), F.col("source_quote").alias("content"), now.cast("string").alias("created_at")
    )
    return joined.withColumn("category", F.coalesce("new_category", "category")).select(*items.columns), log


def rename_category(categories: DataFrame, items: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    rename = lambda df, c: df.withColumn(c, F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)))
    return rename(categories, "name"), rename(items, "category")


def toggle_category(categories: DataFrame, name: str) -> DataFrame:
    return categories.withColumn("enabled", F.when(F.col("name") == name, 1 - F.col("enabled")).otherwise(F.col("enabled")))


def delete_category(categories: DataFrame, items: DataFrame, name: str, purge: bool = False) -> tuple[DataFrame, DataFrame]:
    return categories.where(F.col("name") != name), items.where(~F.col("category").eqNullSafe(F.lit(name))) if purge else items


def toggle_session(sessions: DataFrame, source: str, session_id: str) -> DataFrame:
    """Switch a session; switching it on forgets its read position."""
    mine = (F.col("source") == source) & (F.col("session_id") == session_id)
    position = F.when(mine & (F.col("enabled") == 0), F.lit(None).cast("long")).otherwise(F.col("last_poll_ts"))
    return sessions.withColumns({"last_poll_ts": position, "enabled": F.when(mine, 1 - F.col("enabled")).otherwise(F.col("enabled"))})


def set_reminder(items: DataFrame, item_id, at: str | None) -> DataFrame:
    return items.withColumn("remind_at", F.when(F.col("id") == item_id, F.lit(at)).otherwise(F.col("remind_at")))


#: The categories that a new store starts with (name, colour, enabled). Prompts are a deployment's own.
DEFAULT_CATEGORIES = (
    ("活动通知", "#2563EB", 1), ("社团招新", "#7C3AED", 1), ("学术", "#059669", 1), ("交易", "#D97706", 1), ("实习", "#DB2777", 1),
    ("失物招领", "#DC2626", 0), ("求助互助", "#EA580C", 0), ("组队拼团", "#0891B2", 0), ("兼职家教", "#CA8A04", 0),
    ("免费福利", "#16A34A", 0), ("房屋租售", "#9333EA", 0), ("志愿公益", "#0D9488", 0), ("奖助申报", "#BE185D", 0),
)


def seed_categories(spark: SparkSession, rows: tuple[tuple[str, str, int], ...] = DEFAULT_CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(i, n, "", c, e, "") for i, (n, c, e) in enumerate(rows, 1)], "id long, name string, prompt string, color string, enabled int, created_at string")


def seeded(categories: DataFrame) -> DataFrame:
    """The categories of a store; the default ones where it has none."""
    return seed_categories(categories.sparkSession).select(categories.columns) if categories.isEmpty() else categories


def prune_cases(cases: DataFrame, ids: list[str]) -> DataFrame:
    """cases without the ids; every id must be that of exactly one case."""
    hits = {r["id"]: r["n"] for r in cases.where(F.col("id").isin(ids)).groupBy("id").agg(F.count("*").alias("n")).collect()}  # at most a row per id
    wrong = [i for i in ids if hits.get(i) != 1]
    if wrong:
        raise ValueError(f"not exactly one case each: {wrong}")
    return cases.where(~F.col("id").isin(ids))


def read_windows(sessions: DataFrame, oldest: DataFrame, now: int, backfill_hours: int = 24, overlap: int = 300) -> DataFrame:
    """source, session_id, read_from: some hours back without a read position, else the earlier of the position and the
    oldest unprocessed message, less an overlap."""
    rows = sessions.where("enabled = 1").join(oldest, ["source", "session_id"], "left")
    known = F.least("last_poll_ts", F.coalesce("oldest", "last_poll_ts")) - overlap
    return rows.select("source", "session_id", F.greatest(F.lit(0), F.when(F.col("last_poll_ts").isNull(), F.lit(now - backfill_hours * 3600)).otherwise(known)).alias("read_from"))


def advance_positions(sessions: DataFrame, polled: DataFrame, failed: DataFrame, started: int, any_output: bool) -> DataFrame:
    """Read positions after a cycle: its start time for polled sessions that did not fail, if the batch gave output."""
    if not any_output:
        return sessions
    key = ["source", "session_id"]
    done = polled.select(*key).distinct().join(failed.select(*key), key, "left_anti").withColumn("done__", F.lit(True))
    rows = sessions.join(done, key, "left")
    return rows.withColumn("last_poll_ts", F.when(F.col("done__"), F.lit(started)).otherwise(F.col("last_poll_ts"))).select(*sessions.columns)
