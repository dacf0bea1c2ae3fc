"""Queries of list views: filters, search, counts, pages, calendar, reminders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import times
from larkspur.operators import filters, joins, lists, metrics
from larkspur.plans.frames import ctes, frame, table_of
from larkspur.plans.registry import query

NOW = "2024-01-15 12:00"
_SHOWN = """NOT EXISTS (SELECT 1 FROM categories c WHERE c.name = i.category AND c.enabled = 0)
  AND NOT EXISTS (SELECT 1 FROM sessions s WHERE s.source = i.source AND s.session_id = i.session_id AND s.enabled = 0)"""
_LIST = ctes("items", "categories", "sessions")


def _shown(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return filters.item_list(*(frame(spark, sf_dir, n) for n in ("items", "categories", "sessions")), **how)


@query("items_page", f"{_LIST} SELECT id, title, msg_time FROM items i WHERE is_verified = 0 AND category = 'click' AND {_SHOWN} ORDER BY msg_time DESC, id DESC LIMIT 50 OFFSET 20")
def items_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.page(_shown(spark, sf_dir, category="click"), 50, 20).select("id", "title", "msg_time")


@query("items_filtered", f"{_LIST} SELECT id, title FROM items i WHERE is_verified = 1 AND msg_time >= 1705000000 AND contains(lower(source_group), 'hall 3') AND {_SHOWN}")
def items_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, verified="memo", source_group="hall 3", min_msg_time=1705000000).select("id", "title")


_TERMS = " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in ("topic_3%", "room 7") for c in filters.SEARCHED)


@query("items_search", f"{_LIST} SELECT id, title, category FROM items i WHERE ({_TERMS.replace('room 7', 'room')} OR false) AND {_SHOWN}")
def items_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, verified="all", q="Topic_3%  ROOM").select("id", "title", "category")


@query("items_blank_search", f"{_LIST} SELECT count(*) AS n FROM items i WHERE is_verified = 0 AND {_SHOWN}")
def items_blank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, q="  ").agg(F.count("*").alias("n"))


@query("page_with_totals", f"""{_LIST}, f AS (SELECT * FROM items i WHERE is_verified = 0 AND {_SHOWN}),
  m AS (SELECT count(*) AS total_count, count(DISTINCT CASE WHEN trim(subject, ' ') <> '' THEN concat(trim(subject, ' '), '|', category) END) + count(*) FILTER (WHERE coalesce(trim(subject, ' '), '') = '') AS group_count FROM f),
  c AS (SELECT string_agg(g, '|' ORDER BY g) AS source_groups FROM (SELECT DISTINCT unnest(string_split(source_group, ', ')) AS g FROM f) WHERE g <> '')
  SELECT m.total_count, m.group_count, c.source_groups, p.id FROM m CROSS JOIN c LEFT JOIN (SELECT id FROM f ORDER BY msg_time DESC, id DESC LIMIT 20) p ON true""")
def page_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.page_with_totals(_shown(spark, sf_dir), 20).select("total_count", "group_count", F.array_join("source_groups", "|").alias("source_groups"), "id")


_EXPIRED = f"""{ctes('items')}, p AS (SELECT *, CASE WHEN length("end") = 10 THEN CAST("end" AS DATE) < DATE '2024-01-15' ELSE CAST("end" AS TIMESTAMP) < TIMESTAMP '{NOW}' END AS gone,
  CASE WHEN length("start") = 10 THEN CAST("start" AS DATE) >= DATE '2024-01-15' ELSE CAST("start" AS TIMESTAMP) >= TIMESTAMP '{NOW}' END AS s_ahead, CAST(extra_time AS TIMESTAMP) >= TIMESTAMP '{NOW}' AS x_ahead FROM items)
  SELECT id, coalesce(gone, false) AND NOT coalesce(s_ahead, false) AND NOT coalesce(x_ahead, false) AS expired FROM p"""


@query("expired_items", _EXPIRED)
def expired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "items").select("id", filters.expired(NOW).alias("expired"))


@query("expired_items_sql", _EXPIRED)
def expired_items_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule through its registered SQL function."""
    times.register_expiry(spark)
    points = "item_is_expired(`start`, `end`, extra_times, timestamp '" + NOW + "')"
    return frame(spark, sf_dir, "items").selectExpr("id", f"{points} AS expired")


@query("sync_progress", """WITH e AS (SELECT user_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 3 ELSE 0 END AS started, CASE WHEN event_id % 2 = 1 THEN 1 + event_id % 5 ELSE 0 END AS finished FROM events),
  s AS (SELECT *, sum(started - finished) OVER (PARTITION BY user_id ORDER BY seq) AS level FROM e), p AS (SELECT *, level - least(0, min(level) OVER (PARTITION BY user_id ORDER BY seq)) AS pending FROM s),
  b AS (SELECT *, started > 0 AND coalesce(lag(pending) OVER (PARTITION BY user_id ORDER BY seq), 0) = 0 AS opens FROM p), n AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY seq) AS burst FROM b)
  SELECT seq, CAST(pending AS BIGINT) AS pending, CAST(sum(started) OVER w AS BIGINT) AS new_count, CAST(sum(finished) OVER w AS BIGINT) AS processed_count, pending = 0 AS done FROM n WINDOW w AS (PARTITION BY user_id, burst ORDER BY seq)""")
def sync_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    e = table_of(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.when(even, 1 + F.col("event_id") % 3).otherwise(0).alias("started"), F.when(~even, 1 + F.col("event_id") % 5).otherwise(0).alias("finished"))
    return metrics.sync_progress(e, ["user_id"]).select("seq", "pending", "new_count", "processed_count", "done")


@query("due_reminders", f"{ctes('items')} SELECT id, remind_at FROM items WHERE remind_at <> '' AND remind_at <= '{NOW}' AND is_verified >= 0")
def due_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.due_reminders(frame(spark, sf_dir, "items"), NOW).select("id", "remind_at")


@query("subject_timeline", f"{ctes('items')} SELECT id, msg_time FROM items WHERE subject = 'topic 7' AND is_verified >= 0 ORDER BY msg_time DESC, id DESC LIMIT 40 OFFSET 5")
def subject_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.subject_timeline(frame(spark, sf_dir, "items"), "topic 7", 40, 5).select("id", "msg_time")


@query("timeline_has_more", f"{ctes('items')}, r AS (SELECT id, msg_time FROM items WHERE subject = 'topic 7' AND is_verified >= 0) SELECT id, (SELECT count(*) > 30 FROM r) AS has_more FROM (SELECT * FROM r ORDER BY msg_time DESC, id DESC LIMIT 30)")
def timeline_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.with_more(filters.subject_timeline(frame(spark, sf_dir, "items"), "topic 7"), 30).select("id", "has_more")


@query("calendar_range", f"""{ctes('items')} SELECT id, coalesce("start", "end") AS at FROM items WHERE is_verified >= 0 AND (("start" >= '2024-01-10' AND "start" < '2024-01-13') OR ("end" >= '2024-01-10' AND "end" < '2024-01-13')
  OR (extra_time >= '2024-01-10' AND extra_time < '2024-01-13')) ORDER BY coalesce("start", "end") NULLS FIRST, id LIMIT 1000""")
def calendar_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.calendar_range(frame(spark, sf_dir, "items"), "2024-01-10", "2024-01-13").select("id", F.coalesce("start", "end").alias("at"))


@query("category_counts", f"{ctes('items', 'categories')} SELECT i.category, count(*) AS n, any_value(c.color) AS color FROM items i JOIN categories c ON c.name = i.category AND c.enabled <> 0 WHERE is_verified = 0 GROUP BY i.category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.category_counts(frame(spark, sf_dir, "items"), frame(spark, sf_dir, "categories")).select("category", "n", "color")


@query("categories_with_counts", f"{ctes('items', 'categories')} SELECT name, enabled, (SELECT count(*) FROM items i WHERE i.category = c.name) AS item_count FROM categories c")
def categories_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.categories_with_counts(frame(spark, sf_dir, "categories"), frame(spark, sf_dir, "items")).select("name", "enabled", "item_count")


@query("plain_counts", f"{ctes('items')} SELECT count(*) FILTER (WHERE is_verified = 0) AS open_count, count(*) FILTER (WHERE is_verified = 1) AS memo_count, count(*) FILTER (WHERE is_verified = -1) AS ignored_count FROM items")
def plain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.plain_counts(frame(spark, sf_dir, "items"))


@query("group_count", f"{ctes('items')} SELECT count(DISTINCT CASE WHEN trim(subject, ' ') <> '' THEN concat(trim(subject, ' '), '|', category) END) + count(*) FILTER (WHERE trim(subject, ' ') = '') AS group_count FROM items")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.group_count(frame(spark, sf_dir, "items"))


@query("source_groups", f"{ctes('items')} SELECT DISTINCT unnest(string_split(source_group, ', ')) AS source_group FROM items")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.source_groups(frame(spark, sf_dir, "items"))


@query("group_heads", f"""{ctes('items')}, g AS (SELECT *, coalesce(concat('s:', nullif(trim(subject, ' '), '')), '') AS k FROM items), h AS (SELECT *, CASE WHEN k = 's:' THEN concat('i:', id) ELSE k END AS kk FROM g)
  SELECT id, size FROM (SELECT id, row_number() OVER (PARTITION BY kk, category ORDER BY msg_time DESC, id DESC) AS r, count(*) OVER (PARTITION BY kk, category) AS size FROM h) WHERE r = 1""")
def group_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.group_heads(frame(spark, sf_dir, "items")).select("id", "size")


@query("chat_heads", f"""{ctes('items')}, e AS (SELECT id, msg_time, trim(unnest(string_split(source_group, ','))) AS chat FROM items)
  SELECT chat, id, size FROM (SELECT chat, id, row_number() OVER (PARTITION BY chat ORDER BY msg_time DESC, id DESC) AS r, count(*) OVER (PARTITION BY chat) AS size FROM e) WHERE r = 1""")
def chat_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.chat_heads(frame(spark, sf_dir, "items")).select("chat", "id", "size")


@query("category_samples", f"""{ctes('items')} SELECT id, category, rank FROM (SELECT id, category, source_quote, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id) AS rank FROM items WHERE CAST(created_at AS DATE) >= DATE '2024-01-20')
  WHERE rank <= 25 AND trim(source_quote) <> ''""")
def category_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.newest_per_category(frame(spark, sf_dir, "items"), 25, "2024-01-20").select("id", "category", "rank")


@query("keyword_subscription", f"{ctes('items')} SELECT id, (contains(lower(concat_ws(chr(10), title, source_quote, key_info)), 'room') OR contains(lower(concat_ws(chr(10), title, source_quote, key_info)), 'no. 5')) AS hit FROM items".replace("'no. 5'", "'quote 17'"))
def keyword_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("Room", True), ("Hall zzz", False)], "entry string, enabled boolean")
    hit = filters.keyword_match(frame(spark, sf_dir, "items"), words)
    more = filters.matches_search("", ()) & F.contains(F.lower(F.concat_ws("\n", "title", "source_quote", "key_info")), F.lit("quote 17"))
    return hit.select("id", (F.col("hit") | more).alias("hit"))


@query("sessions_view", f"{ctes('sessions')} SELECT session_id, name FROM sessions WHERE is_group = 1 AND source = 'app' AND last_active >= 1704067800")
def sessions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sessions_view(frame(spark, sf_dir, "sessions"), "group", "app", 1704067800).select("session_id", "name")


@query("sessions_by_name", f"{ctes('sessions')} SELECT name, session_id FROM sessions WHERE enabled = 1")
def sessions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.sessions_by_name(frame(spark, sf_dir, "sessions"), True).select("name", "session_id")


@query("time_badges", f"""{ctes('items')}, p AS (SELECT id, unnest(["start", "end", extra_time]) AS t FROM items),
  a AS (SELECT id, bool_or(CASE WHEN length(t) = 10 THEN CAST(t AS DATE) >= DATE '2024-01-15' ELSE CAST(t AS TIMESTAMP) >= TIMESTAMP '{NOW}' END) AS coming FROM p WHERE t IS NOT NULL GROUP BY id),
  b AS (SELECT i.id, i."end" AS e, i."start" AS s, coalesce(a.coming, false) AS coming, epoch(CAST(i."end" AS TIMESTAMP)) - epoch(TIMESTAMP '{NOW}') AS left_s FROM items i LEFT JOIN a ON a.id = i.id)
  SELECT id, CASE WHEN e IS NOT NULL AND length(e) = 10 THEN CASE WHEN CAST(e AS DATE) < DATE '2024-01-15' THEN CASE WHEN coming THEN 'partial' ELSE 'expired' END WHEN CAST(e AS DATE) = DATE '2024-01-15' THEN 'urgent' WHEN ceil(left_s / 86400) <= 3 THEN 'soon' ELSE 'later' END
    WHEN e IS NOT NULL THEN CASE WHEN left_s < 0 THEN CASE WHEN coming THEN 'partial' ELSE 'expired' END WHEN floor(left_s / 60) < 1440 THEN 'urgent' WHEN floor(left_s / 60) < 4320 THEN 'soon' ELSE 'later' END
    WHEN s IS NOT NULL AND length(s) = 10 THEN CASE WHEN CAST(s AS DATE) < DATE '2024-01-15' THEN 'started' WHEN CAST(s AS DATE) = DATE '2024-01-15' THEN 'today' ELSE 'later' END
    WHEN s IS NOT NULL THEN CASE WHEN CAST(s AS TIMESTAMP) < TIMESTAMP '{NOW}' THEN 'started' WHEN CAST(s AS DATE) = DATE '2024-01-15' THEN 'today' ELSE 'later' END END AS badge FROM b""")
def time_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return frame(spark, sf_dir, "items").select("id", times.time_badge(F.col("start"), F.col("end"), F.col("extra_times"), now).alias("badge"))
