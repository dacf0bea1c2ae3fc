"""Streaming ingest: micro-batches of messages through the entry filter, an idempotent store and ordered stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.filters import entry_filter
from larkspur.operators.state import insert_new
from larkspur.sources.events import messages_only, parse_frames

Stage = Callable[[DataFrame], DataFrame]
SLOTS = ("pre_classify", "post_classify", "pre_insert", "post_insert")


@dataclass(order=True)
class _Registered:
    priority: int
    seq: int
    name: str = field(compare=False)
    stage: Stage = field(compare=False)
    after: tuple[str, ...] = field(compare=False, default=())


class StageChain:
    """Stages in four slots; within a slot by dependency, then priority, then order of registration."""

    def __init__(self) -> None:
        self._slots: dict[str, list[_Registered]] = {s: [] for s in SLOTS}

    def register(self, slot: str, name: str, stage: Stage, priority: int = 0, after: tuple[str, ...] = ()) -> None:
        self._slots[slot].append(_Registered(priority, len(self._slots[slot]), name, stage, after))

    def order(self, slot: str) -> list[str]:
        return [r.name for r in self._ordered(slot)]

    def _ordered(self, slot: str) -> list[_Registered]:
        waiting, done = sorted(self._slots[slot]), []
        names = {r.name for r in waiting}
        while waiting:
            ready = next((r for r in waiting if all(a not in names or a in {d.name for d in done} for a in r.after)), None)
            if ready is None:
                raise ValueError(f"stages depend on each other: {[r.name for r in waiting]}")
            waiting.remove(ready)
            done.append(ready)
        return done

    def run(self, df: DataFrame) -> DataFrame:
        for slot in SLOTS:
            for r in self._ordered(slot):
                df = df.transform(r.stage)
        return df


def listen(lines: DataFrame, event_time: str = "arrived", lateness: str = "10 minutes") -> DataFrame:
    """A stream of frame lines with an arrival time -> events, once per (event, rawid) within the lateness."""
    events = messages_only(parse_frames(lines))
    return events.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["event", "rawid"])


@dataclass
class Store:
    """Tables of a store as Parquet folders; each batch appends a folder of its own, so a replayed batch replaces itself."""

    spark: SparkSession
    root: str

    def read(self, table: str, ddl: str) -> DataFrame:
        path = f"{self.root}/{table}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def append(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_id:010d}")


RAW = "source string, msg_id string, session_id string, content string, timestamp long"
PROCESSED = "source string, msg_id string"


def ingest_batch(batch: DataFrame, batch_id: int, store: Store, sessions: DataFrame, chain: StageChain) -> None:
    """One micro-batch: entry filter, raw messages that the store lacks, the stages, then the processed marks.

    A batch that runs again finds its marks missing or complete, so each message is stored once (at least once delivery,
    idempotent tables).
    """
    earlier = lambda t, ddl: store.read(t, ddl + ", batch string").where(F.coalesce("batch", F.lit("")) != f"{batch_id:010d}").drop("batch")
    fresh = entry_filter(batch, sessions, earlier("processed", PROCESSED))
    rows = insert_new(earlier("raw", RAW), fresh.select("source", "msg_id", "session_id", "content", "timestamp"), ["source", "msg_id"]).persist()
    store.append(rows, "raw", batch_id)
    store.append(chain.run(rows), "items", batch_id)
    store.append(rows.select("source", "msg_id"), "processed", batch_id)
    rows.unpersist()


def start_ingest(messages: DataFrame, store: Store, sessions: DataFrame, chain: StageChain, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run the ingest over a stream: all that is there (a scheduled job), or every interval."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: ingest_batch(df, i, store, sessions, chain))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
