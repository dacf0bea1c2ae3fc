"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_samples(samples: DataFrame, overlay: DataFrame, overlay_weight: float = 2.0) -> DataFrame:
    """Samples (content, category) of weight 1 and corrections of a higher weight, as one frame with an order."""
    a = samples.select("content", "category", F.lit(1.0).alias("weight"))
    b = overlay.select("content", "category", F.lit(overlay_weight).alias("weight"))
    return a.unionByName(b).withColumn("seq", F.xxhash64("content", "category", "weight"))


def point_difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with missing (in a, not in b) and extra (in b, not in a) for two arrays."""
    return rows.withColumns({"missing": F.array_sort(F.array_except(a, b)), "extra": F.array_sort(F.array_except(b, a))})


def removed_keys(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    return before.select(*key).distinct().join(now.select(*key), key, "left_anti")


def overlap_violations(training: DataFrame, held_out: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Fingerprints that both sets have; none may."""
    return training.select(key).distinct().join(held_out.select(key), key, "left_semi")
