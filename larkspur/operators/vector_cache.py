"""The vectors of one model as a table that is appended to while that is right and built anew where it is not.

The store is (source, msg_id, model, embedding as JSON, created_at). A refresh reads what is as new as the last one saw, ends
included, and adds it as a segment; a key's newest segment holds. The cache is built anew, as a further generation, where it is
forced, where the model is another, where the store has fewer rows than before (a removed row has no time to find it by),
and where all new vectors agree on another dimension. A segment counts once its manifest row is whole, so a refresh that
fails leaves the cache as it was and is done again.

Defined results: rows that are no vector, or of another dimension than the cache, are returned as bad and never enter; with no
cache the most frequent dimension holds, the larger of two equals; an empty store gives an empty cache; extra columns are
ignored; rows that repeat a key are one, the newest, and of equally new ones the one that compares greater.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.jsonx import vector
from larkspur.operators.survivors import Snapshots
from larkspur.scratch import written

KEY = ["source", "msg_id"]
_MANIFEST = "generation long, model string, dimension int, watermark string, rows long, segment string"


@dataclass
class Refreshed:
    kind: str  #: "rebuild", "append" or "none"
    dimension: int | None
    bad: DataFrame  #: (source, msg_id, why): rows to remove from the store and embed again


class VectorCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Snapshots(spark, f"{self.path}/manifest")

    def _newest(self):
        table = self.manifests.newest()
        return table.first() if table is not None else None

    def _segments(self, generation: int) -> list[str]:
        """The segments of a generation, oldest first; a row a refresh."""
        numbers = self.manifests.numbers()
        rows = self.spark.read.schema(_MANIFEST + ", run int").parquet(self.manifests.path).where(F.col("generation") == generation)
        return [r["segment"] for r in sorted(rows.collect(), key=lambda r: r["run"]) if r["run"] in numbers and r["segment"]]

    def vectors(self) -> DataFrame | None:
        """source, msg_id, vec, created_at of the cache; None before the first refresh."""
        now = self._newest()
        if now is None:
            return None
        parts = [self.spark.read.parquet(p).withColumn("at", F.lit(i)) for i, p in enumerate(self._segments(now["generation"]))]
        if len(parts) == 1:  # one row a key as written
            return parts[0].drop("at")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.groupBy(*KEY).agg(F.max_by(F.struct("vec", "created_at"), "at").alias("v")).select(*KEY, "v.vec", "v.created_at")

    def _fetched(self, store: DataFrame, model: str, since: str | None) -> tuple[DataFrame, dict[int, int]]:
        """(rows of the model since a time with their vectors, {dimension: rows})."""
        own = store.where(F.col("model") == model)
        if since is not None:
            own = own.where(F.col("created_at") >= since)
        one = own.groupBy(*KEY).agg(F.max(F.struct("created_at", "embedding")).alias("r")).select(*KEY, "r.created_at", vector(F.col("r.embedding")).alias("vec"))
        fresh = written(one, "fetched")
        return fresh, {r["d"]: r["count"] for r in fresh.where("vec IS NOT NULL").groupBy(F.size("vec").alias("d")).count().collect()}

    def refresh(self, store: DataFrame, model: str, force: bool = False) -> Refreshed:
        now, total = self._newest(), store.count()
        anew = now is None or now["model"] != model or total < now["rows"]
        known = None if anew else now["dimension"]
        fresh, dims = self._fetched(store, model, None if anew or force else now["watermark"])
        if known is None:
            dimension = max(dims, key=lambda d: (dims[d], d), default=None)
        elif len(dims) == 1 and known not in dims:
            (dimension,) = dims
            if not force:  # rows of that dimension from before belong to the cache now
                fresh, _ = self._fetched(store, model, None)
            anew = True
        else:
            dimension = known
        anew = anew or force
        size = F.size("vec")
        why = F.when(F.col("vec").isNull(), "no vector").when(size != F.lit(dimension), "dimension")
        bad = fresh.withColumn("why", why).where("why IS NOT NULL").select(*KEY, "why")
        latest = fresh.agg(F.max("created_at").alias("t")).first()["t"]
        if latest is None and not anew:
            return Refreshed("none", dimension, bad)
        generation = now["generation"] + anew if now else 1
        run = (self.manifests.numbers() or [0])[-1] + 1
        segment = f"{self.path}/vectors/generation={generation}/run={run}"
        fresh.where((size == F.lit(dimension)) if dimension else F.lit(False)).select(*KEY, "vec", "created_at").write.mode("overwrite").parquet(segment)
        row = (generation, model, dimension, latest or ("" if anew else now["watermark"]), total, segment)
        self.manifests.add(self.spark.createDataFrame([row], _MANIFEST).coalesce(1))
        return Refreshed("rebuild" if anew else "append", dimension, bad)
