"""Server-sent event frames: lines of `data:` JSON become rows; anything else is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a frame may have at most.
FRAME_BYTES = 1 << 20
EVENT = "event string, rawid string, sessionId string, sender string, senderName string, content string, timestamp long"


def parse_frames(lines: DataFrame, schema: str = EVENT, value: str = "value") -> DataFrame:
    """Rows of text lines -> events. Works on batches and streams alike."""
    text = F.regexp_extract(F.col(value), r"^data:\s?(.*)$", 1)
    fits = F.octet_length(F.col(value)) <= FRAME_BYTES
    parsed = lines.where(F.col(value).startswith("data:") & fits).withColumn("e__", F.from_json(text, schema))
    return parsed.where("e__ IS NOT NULL AND (e__.event IS NOT NULL OR e__.content IS NOT NULL)").select("e__.*", *[c for c in lines.columns if c != value])


def messages_only(events: DataFrame, control: tuple[str, ...] = ("ping", "ready", "heartbeat")) -> DataFrame:
    return events.where(~F.coalesce(F.col("event").isin(*control), F.lit(False)))
