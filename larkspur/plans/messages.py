"""Queries over messages, their context and the state of reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text, times
from larkspur.operators import alignment, filters, joins, lists, metrics, state
from larkspur.plans.frames import ctes, frame, table_of
from larkspur.plans.registry import query
from larkspur.sources import normalise


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "raw_messages")
    return rows.withColumns({"is_self": (F.col("sender_id") == "assistant") & (F.col("msg_id") % 7 == 0), "image_urls": F.array().cast("array<string>")})


_ENTRY = f"""{ctes('raw_messages', 'chat_sessions', 'processed')}, r AS (SELECT m.*, CASE WHEN sender_id = 'assistant' AND msg_id % 7 = 0 THEN 'self'
  WHEN NOT EXISTS (SELECT 1 FROM chat_sessions s WHERE s.source = m.source AND s.session_id = m.session_id AND s.enabled = 1) THEN 'session'
  WHEN EXISTS (SELECT 1 FROM processed p WHERE p.source = m.source AND p.msg_id = m.msg_id) THEN 'processed' END AS reason FROM raw_messages m)"""


@query("entry_filter", f"{_ENTRY} SELECT msg_id, session_id FROM r WHERE reason IS NULL")
def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.entry_filter(_messages(spark, sf_dir), frame(spark, sf_dir, "chat_sessions"), frame(spark, sf_dir, "processed")).select("msg_id", "session_id")


@query("entry_counters", f"{_ENTRY} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def entry_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.entry_counters(_messages(spark, sf_dir), frame(spark, sf_dir, "chat_sessions"), frame(spark, sf_dir, "processed"))


@query("context_window", f"""{ctes('raw_messages')}, a AS (SELECT source, session_id, timestamp AS anchor, msg_id AS target FROM raw_messages WHERE (msg_id - session_id * 1000) = 2),
  w AS (SELECT r.*, a.anchor, a.target, row_number() OVER (PARTITION BY a.session_id, r.timestamp >= a.anchor ORDER BY abs(r.timestamp - a.anchor), r.msg_id) AS k FROM raw_messages r JOIN a USING (source, session_id) WHERE r.timestamp BETWEEN a.anchor - 3600 AND a.anchor + 3600)
  SELECT session_id, anchor, msg_id FROM w WHERE k <= 15 OR msg_id = target""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frame(spark, sf_dir, "raw_messages")
    anchors = raw.where("(msg_id - session_id * 1000) = 2").select("source", "session_id", F.col("timestamp").alias("anchor"), F.col("msg_id").alias("target_msg_id"))
    return joins.context_window(raw, anchors).select("session_id", "anchor", "msg_id")


@query("context_sender", f"""{ctes('raw_messages', 'chat_sessions', 'contacts')} SELECT msg_id, coalesce(CASE WHEN s.is_group = 1 AND r.sender_name <> '' AND r.sender_name <> r.sender_id THEN r.sender_name END, c.display_name, r.sender_name, r.sender_id) AS sender
  FROM raw_messages r LEFT JOIN contacts c USING (source, sender_id) LEFT JOIN chat_sessions s ON s.source = r.source AND s.session_id = r.session_id""")
def context_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_sender(frame(spark, sf_dir, "raw_messages"), frame(spark, sf_dir, "contacts"), frame(spark, sf_dir, "chat_sessions")).select("msg_id", "sender")


_OLDEST = "o AS (SELECT source, session_id, min(timestamp) AS oldest FROM raw_messages r WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.source = r.source AND p.msg_id = r.msg_id) GROUP BY ALL)"


@query("oldest_unprocessed", f"{ctes('raw_messages', 'processed')}, {_OLDEST} SELECT session_id, oldest FROM o")
def oldest_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.oldest_unprocessed(frame(spark, sf_dir, "raw_messages"), frame(spark, sf_dir, "processed")).select("session_id", "oldest")


@query("read_windows", f"""{ctes('raw_messages', 'processed', 'chat_sessions')}, {_OLDEST} SELECT s.session_id, greatest(0, CASE WHEN last_poll_ts IS NULL THEN 1800000000 - 86400 ELSE least(last_poll_ts, coalesce(oldest, last_poll_ts)) - 300 END) AS read_from
  FROM chat_sessions s LEFT JOIN o USING (source, session_id) WHERE s.enabled = 1""")
def read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    oldest = joins.oldest_unprocessed(frame(spark, sf_dir, "raw_messages"), frame(spark, sf_dir, "processed"))
    return state.read_windows(frame(spark, sf_dir, "chat_sessions"), oldest, 1_800_000_000).select("session_id", "read_from")


@query("advance_positions", f"{ctes('chat_sessions')} SELECT session_id, coalesce(CASE WHEN enabled = 1 AND session_id % 4 <> 0 THEN 1900000000 ELSE last_poll_ts END, -1) AS last_poll_ts FROM chat_sessions")
def advance_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame(spark, sf_dir, "chat_sessions")
    return state.advance_positions(s, s.where("enabled = 1"), s.where("session_id % 4 = 0"), 1_900_000_000, True).select("session_id", F.coalesce("last_poll_ts", F.lit(-1)).cast("bigint").alias("last_poll_ts"))


@query("processed_probe", f"{ctes('raw_messages', 'processed')} SELECT msg_id FROM raw_messages r WHERE session_id % 2 = 0 AND EXISTS (SELECT 1 FROM processed p WHERE p.source = r.source AND p.msg_id = r.msg_id)")
def processed_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.processed_among(frame(spark, sf_dir, "raw_messages").where("session_id % 2 = 0"), frame(spark, sf_dir, "processed")).select("msg_id")


@query("retrieval_scope", f"{ctes('raw_messages', 'chat_sessions')} SELECT msg_id FROM raw_messages r WHERE trim(content) <> '' AND EXISTS (SELECT 1 FROM chat_sessions s WHERE s.source = r.source AND s.session_id = r.session_id AND s.enabled = 1 AND s.is_group = 1)")
def retrieval_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frame(spark, sf_dir, "raw_messages").where(filters.indexable(F.col("content")))
    return filters.in_scope(raw, frame(spark, sf_dir, "chat_sessions")).select("msg_id")


@query("backfill_candidates", f"""{ctes('raw_messages', 'chat_sessions', 'processed')} SELECT msg_id FROM raw_messages r WHERE timestamp >= 1700050000 AND trim(content) <> '' AND msg_id % 3 <> 0 AND msg_id % 11 <> 0
  AND EXISTS (SELECT 1 FROM chat_sessions s WHERE s.session_id = r.session_id AND s.enabled = 1 AND s.is_group = 1) ORDER BY timestamp DESC, msg_id LIMIT 100""")
def backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frame(spark, sf_dir, "raw_messages")
    chunks = frame(spark, sf_dir, "processed")
    vectors = chunks.withColumn("model", F.lit("m1"))
    skipped = raw.where("msg_id % 11 = 0").select("source", "msg_id")
    return joins.backfill_candidates(raw, chunks, vectors, skipped, frame(spark, sf_dir, "chat_sessions"), "m1", 1700050000, 100).select("msg_id")


@query("orphan_gc", f"{ctes('raw_messages', 'processed')} SELECT msg_id FROM processed p WHERE NOT EXISTS (SELECT 1 FROM raw_messages r WHERE r.msg_id = p.msg_id AND r.session_id % 2 = 0)")
def orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = frame(spark, sf_dir, "raw_messages").where("session_id % 2 = 0")
    return joins.orphans(frame(spark, sf_dir, "processed"), live, ["source", "msg_id"]).select("msg_id")


@query("skip_marking", f"{ctes('raw_messages')} SELECT msg_id FROM raw_messages WHERE msg_id % 4 <> 0 AND msg_id % 5 <> 0")
def skip_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frame(spark, sf_dir, "raw_messages")
    return filters.skipped(raw, raw.where("msg_id % 4 = 0"), raw.where("msg_id % 5 = 0")).select("msg_id")


@query("batch_split", f"{ctes('raw_messages')} SELECT msg_id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY timestamp, msg_id) - 1) // 3 AS BIGINT) AS batch FROM raw_messages")
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.batches(frame(spark, sf_dir, "raw_messages"), ["session_id"], ["timestamp", "msg_id"], 3).select("msg_id", "batch")


@query("prompt_lines", f"""{ctes('raw_messages').replace('WITH', 'WITH RECURSIVE', 1)}, m AS (SELECT session_id % 25 AS batch_id, msg_id AS seq, least(400, length(coalesce(content, ''))) AS n, min(msg_id) OVER (PARTITION BY session_id % 25, source, session_id) AS first FROM raw_messages),
  c AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY first, seq, n) AS i FROM m),
  f AS (SELECT batch_id, seq, i, n <= 4000 AS kept, CASE WHEN n <= 4000 THEN n ELSE 0 END AS used FROM c WHERE i = 1
    UNION ALL SELECT c.batch_id, c.seq, c.i, used + n <= 4000, CASE WHEN used + n <= 4000 THEN used + n ELSE used END FROM f JOIN c ON c.batch_id = f.batch_id AND c.i = f.i + 1)
  SELECT batch_id, seq, kept FROM f""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "raw_messages").select((F.col("session_id") % 25).alias("batch_id"), F.col("msg_id").alias("seq"), "source", "session_id", "content")
    return lists.prompt_lines(rows).select("batch_id", "seq", "kept")


@query("uncertain_counts", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'uncertain' WHEN event_type = 'signup' THEN 'ok' END AS outcome FROM events), k AS (SELECT user_id, max(event_id) AS ok FROM e WHERE outcome = 'ok' GROUP BY 1)
  SELECT e.user_id, count(*) AS uncertain_count, concat('v', min(e.event_id) % 5) AS version FROM e LEFT JOIN k USING (user_id) WHERE outcome = 'uncertain' AND (ok IS NULL OR event_id > ok) GROUP BY e.user_id""")
def uncertain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table_of(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ts"), F.concat(F.lit("v"), F.col("event_id") % 5).alias("version"), F.when(F.col("event_type") == "error", "uncertain").when(F.col("event_type") == "signup", "ok").alias("outcome"))
    return metrics.uncertain_counts(e, ["user_id"])


@query("mask_pii")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "documents").select("doc_id", text.mask_pii("text").alias("masked"))


@query("normalize_subject")
def normalize_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "documents").select("doc_id", text.normalize_subject("text").alias("subject"))


@query("date_hints")
def date_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_of(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "M月d日"), F.lit(" 下周三 "), F.date_format("ts", "HH:mm")).alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    hints = F.to_json(times.time_hints("t"))
    return rows.select("event_id", F.to_json(times.parse_dates("t", "day")).alias("times"), hints.alias("hints"))


@query("local_minutes", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, substring(sha256(concat('app', chr(10), event_id)), 1, 12) AS key FROM events".replace("chr(10)", "'-'"))
def local_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.digest(F.concat(F.lit("app-"), F.col("event_id").cast("string")), 12)
    return table_of(spark, sf_dir, "events").select("event_id", times.local_minute(F.unix_timestamp("ts")).alias("minute"), key.alias("key"))


@query("article_explode", """WITH a AS (SELECT event_id, user_id, unnest(range(1, 4)) AS i, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n, event_type FROM events)
  SELECT concat('m', event_id, '_', i) AS msg_id, concat('标题：', event_type, ' & ', i, CASE WHEN n = 3 AND i = 2 THEN '' ELSE concat(chr(10), '摘要：about ', user_id) END) AS content, concat('http://a.example/', i, '?x=1&y=2') AS article_url FROM a WHERE i <= n
  UNION ALL SELECT concat('m', event_id), event_type, '' FROM a WHERE n = 0 AND i = 1""")
def article_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user, n = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 3
    url = lambda i: F.lit(f"<url><![CDATA[http://a.example/{i}?x=1&y=2]]></url>")
    first = F.concat(F.lit("<item><title><![CDATA["), kind, F.lit(" & 1]]></title><summary> about "), user, F.lit("</summary>"), url(1), F.lit("</item>"))
    second = F.concat(F.lit("<item><title></title><title_v2>"), kind, F.lit(" &amp; 2</title_v2><summary></summary>"), url(2), F.lit("</item>"))
    third = F.concat(F.lit("<item><title>\n"), kind, F.lit(" &amp; 3 </title><summary><![CDATA[about "), user, F.lit("]]></summary>"), url(3), F.lit("</item><item><text_title>video</text_title></item>"))
    many = F.concat(F.lit("<msg><appmsg><title>outer</title><mmreader><category>"), first, second, third, F.lit("</category></mmreader></appmsg></msg>"))
    one = F.concat(F.lit("  <msg><appmsg><title>"), kind, F.lit(" &amp; 1</title><des>about "), user, F.lit("</des>"), url(1), F.lit("<mmreader><title>inner</title></mmreader></appmsg></msg>"))
    rows = table_of(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("event_id")).alias("msg_id"), kind.alias("content"), F.lit("").alias("article_url"), F.when(n == 0, many).when(n == 1, one).otherwise(F.lit("<item><title>no card</title></item>")).alias("raw_xml"))
    return normalise.explode_articles(rows).select("msg_id", "content", "article_url")


def turn_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(quotes, contents): the turns of conversations in batches of twenty, and of each turn a quote, cut from its own text, from
    that of the turn before (each fourth), or half from either (each fifth)."""
    turns = table_of(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.floor(F.col("turn") / 20).alias("part"), F.col("turn").alias("idx"), F.col("text").alias("content"))
    rows = turns.where("conv IS NOT NULL AND idx IS NOT NULL").dropDuplicates(["conv", "idx"]).withColumn("batch_id", F.concat_ws(":", "conv", "part"))
    before = F.coalesce(F.lag("content").over(Window.partitionBy("batch_id").orderBy("idx")), F.lit(""))
    own = F.substring("content", 3, 30)
    quote = F.when(F.col("idx") % 5 == 4, F.concat(F.substring("content", 3, 12), F.substring(before, 3, 12))).when(F.col("idx") % 4 == 3, F.substring(before, 3, 30)).otherwise(own)
    return rows.select("batch_id", "idx", quote.alias("quote")), rows.select("batch_id", "idx", "content")


@query("quote_alignment")
def quote_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.literal_verdicts(*turn_quotes(spark, sf_dir)).select("batch_id", "idx", "own", "aligned")
