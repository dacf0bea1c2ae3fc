"""The driver's tables in the shape of the message store, for Spark and as DuckDB common table expressions.

Each frame is a list of (column, expression) over one table. Where the dialects differ, the expression holds a macro.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import ship_package

_MACROS = {
    "epoch": ("unix_timestamp({0})", "CAST(floor(epoch({0})) AS BIGINT)"),
    "minute": ("date_format({0}, 'yyyy-MM-dd HH:mm')", "strftime({0}, '%Y-%m-%d %H:%M')"),
    "iso": ("date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime({0}, '%Y-%m-%dT%H:%M:%S')"),
    "sha": ("substring(sha2({0}, 256), 1, 16)", "substring(sha256({0}), 1, 16)"),
    "floats": ("transform({0}, x -> double(x))", "CAST({0} AS DOUBLE[])"),
}

_CARD = {
    "id": "event_id",
    "source": "'app'",
    "source_msg_id": "concat('m', event_id)",
    "session_id": "concat('s', user_id)",
    "source_group": "CASE WHEN event_id % 3 = 0 THEN concat('Group ', user_id % 7, ', Hall ', user_id % 5) ELSE concat('Group ', user_id % 7) END",
    "sender_name": "concat('User ', user_id)",
    "category": "event_type",
    "title": "concat(event_type, ' No. ', event_id % 97)",
    "subject": "CASE WHEN event_id % 4 = 0 THEN ' ' ELSE concat('topic ', event_id % 53) END",
    "key_info": "CASE WHEN event_id % 5 = 0 THEN concat('Room ', event_id % 13) END",
    "source_quote": "CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat('Quote ', event_id % 301, ' on Topic_', event_id % 7, '%') END",
    "content_hash": "@sha(concat('Quote ', event_id % 301, ' on Topic_', event_id % 7, '%'))",
    "msg_time": "@epoch(ts)",
    "is_verified": "CASE WHEN event_id % 6 = 0 THEN 1 WHEN event_id % 6 = 1 THEN -1 ELSE 0 END",
    "verified_at": "CASE WHEN event_id % 6 < 2 THEN @iso(ts + INTERVAL 1 DAY) END",
    "start": "CASE WHEN event_id % 3 = 0 THEN @minute(ts) WHEN event_id % 3 = 1 THEN substring(@minute(ts + INTERVAL 1 DAY), 1, 10) END",
    "end": "CASE WHEN event_id % 4 = 0 THEN @minute(ts + INTERVAL 2 DAY) WHEN event_id % 4 = 1 THEN substring(@minute(ts), 1, 10) END",
    "extra_time": "CASE WHEN event_id % 10 = 0 THEN @minute(ts + INTERVAL 9 DAY) END",
    "remind_at": "CASE WHEN event_id % 8 = 0 THEN @minute(ts + INTERVAL 1 DAY) END",
    "created_at": "ts",
    "value": "value",
}
FRAMES: dict[str, tuple[str, dict[str, str], str]] = {
    # name: (table, columns, what follows the FROM clause)
    "items": ("events", _CARD, ""),
    "new_items": ("events", _CARD, ""),
    "sessions": ("events", {"source": "'app'", "session_id": "concat('s', user_id)", "name": "concat('Chat ', user_id % 40)", "is_group": "CAST(user_id % 2 AS INT)", "is_official": "CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END", "enabled": "CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END", "last_active": "1704067200 + user_id * 60", "last_poll_ts": "CASE WHEN user_id % 3 > 0 THEN 1704067200 + user_id * 7000 END"}, "DISTINCT"),
    "categories": ("events", {"name": "event_type", "color": "concat('#', length(event_type))", "enabled": "CASE WHEN length(event_type) = 6 THEN 0 ELSE 1 END"}, "DISTINCT"),
    "raw_messages": ("conversations", {"source": "'app'", "msg_id": "conv_id * 1000 + turn", "session_id": "conv_id", "group_name": "concat('chat ', conv_id % 20)", "sender_id": "role", "sender_name": "CASE WHEN turn % 2 = 0 THEN role ELSE concat('Nick ', role) END", "content": "text", "timestamp": "1700000000 + conv_id * 3600 + turn * 80"}, ""),
    "chat_sessions": ("conversations", {"source": "'app'", "session_id": "conv_id", "is_group": "CAST(conv_id % 2 AS INT)", "enabled": "CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END", "last_poll_ts": "CASE WHEN conv_id % 3 > 0 THEN 1700000000 + conv_id * 3600 + 200 END"}, "DISTINCT"),
    "contacts": ("conversations", {"source": "'app'", "sender_id": "role", "display_name": "concat('Contact ', role)"}, "DISTINCT"),
    "processed": ("conversations", {"source": "'app'", "msg_id": "conv_id * 1000 + turn"}, "WHERE (conv_id * 1000 + turn) % 3 = 0"),
    "doc_cards": ("documents", {"id": "doc_id", "title": "text", "category": "lang", "source_group": "source", "content_hash": "@sha(text)", "msg_time": "doc_id * 60"}, ""),
    "vectors": ("embeddings", {"id": "vec_id", "vec": "@floats(embedding)", "category": "label"}, ""),
}


def _expand(expr: str, duck: bool) -> str:
    while m := re.search(r"@(\w+)\(", expr):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[i], 0)
            i += 1
        expr = expr[: m.start()] + _MACROS[m[1]][duck].format(expr[m.end() : i - 1]) + expr[i:]
    return expr


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, rest = FRAMES[name]
    df = table_of(spark, sf_dir, table)
    if rest.startswith("WHERE"):
        df = df.where(rest[6:])
    df = df.selectExpr(*[f"{_expand(e, False)} AS `{c}`" for c, e in columns.items()])
    if "extra_time" in columns:
        points = F.array(F.struct(F.lit("start").alias("type"), F.col("extra_time").alias("time"), F.lit("more").alias("label")))
        df = df.withColumn("extra_times", F.when(F.col("extra_time").isNotNull(), points)).drop("extra_time")
    return df.distinct() if rest == "DISTINCT" else df


def table_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ctes(*names: str) -> str:
    """WITH clause of the frames in DuckDB's SQL, open for more."""
    out = []
    for name in names:
        table, columns, rest = FRAMES[name]
        cols = ", ".join(f'{_expand(e, True)} AS "{c}"' for c, e in columns.items())
        out.append(f"{name} AS (SELECT {'DISTINCT ' if rest == 'DISTINCT' else ''}{cols} FROM {table} {rest if rest.startswith('WHERE') else ''})")
    return "WITH " + ",\n".join(out)
