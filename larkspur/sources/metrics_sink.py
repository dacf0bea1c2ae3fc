"""Metrics on their way out of a stream: the latest snapshot, a daily log of snapshots, and decisions kept for calibration.

A sink is the body of a `foreachBatch`. What a batch writes stands in partitions of its own, which a repeated batch writes over,
so a batch that is done twice leaves its rows once. The latest snapshot is a numbered table that counts once it is whole;
readers never see half of one. Days beyond their retention are dropped as folders, without reading them.

Defined results: an empty snapshot writes nothing, so the readings of an earlier run stay; snapshots come at most once in
`every` seconds, decisions with every batch, since a batch cannot wait; a folder whose day is no date is left alone; decisions
without a time go to no day and are kept.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.survivors import Snapshots


class MetricsSink:
    def __init__(self, spark: SparkSession, path: str, every: int = 30, snapshot_days: int = 14, decision_days: int = 180):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.days = {"snapshots": snapshot_days, "decisions": decision_days}
        self.newest, self.last = Snapshots(spark, f"{self.path}/latest"), None

    def latest(self) -> DataFrame | None:
        return self.newest.newest()

    def log(self, name: str) -> DataFrame:
        """The rows of "snapshots" or "decisions" with their day and batch."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _append(self, rows: DataFrame, name: str, batch: int) -> None:
        placed = rows.withColumn("batch", F.lit(batch).cast("long"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/{name}")

    def prune(self, today: date) -> list[str]:
        """Drop the days that are older than their retention; returns their folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        dropped = []
        for name, days in self.days.items():
            root = path(f"{self.path}/{name}")
            files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for entry in files.listStatus(root) if files.exists(root) else []:
                try:
                    day = date.fromisoformat(entry.getPath().getName().removeprefix("day="))
                except ValueError:
                    continue
                if today - day > timedelta(days=days) and files.delete(entry.getPath(), True):
                    dropped.append(f"{name}/day={day}")
        return dropped

    def flush(self, batch: int, now: datetime, snapshot: DataFrame | None = None, decisions: DataFrame | None = None, ts: str = "ts") -> bool:
        """Write a batch; returns whether its snapshot was written. `decisions` go to the day of their `ts`, snapshots to today."""
        self.prune(now.date())
        if decisions is not None:
            self._append(decisions.withColumn("day", F.to_date(ts)), "decisions", batch)
        if snapshot is None or self.last is not None and (now - self.last).total_seconds() < self.every:
            return False
        self.last = now
        if snapshot.isEmpty():
            return False
        self.newest.add(snapshot)
        self.newest.drop_older()
        self._append(snapshot.withColumns({"at": F.lit(now), "day": F.lit(now.date())}), "snapshots", batch)
        return True
