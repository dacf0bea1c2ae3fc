"""The OCR port: image bytes to text, with the rules that place the text in a message."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import is_placeholder_only, mask_pii


class Reader(Protocol):
    def read(self, image: bytes) -> str | None: ...


def recognise(images: DataFrame, factory: Callable[[], Reader]) -> DataFrame:
    """images (source, msg_id, n, bytes) -> source, msg_id, text: the masked texts of a message's images in order."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = factory()
        for pdf in batches:
            yield pdf[["source", "msg_id", "n"]].assign(text=[reader.read(bytes(b)) if b is not None else None for b in pdf["bytes"]])

    read = images.mapInPandas(call, "source string, msg_id string, n int, text string").where("trim(text) <> ''")
    line = F.concat(F.lit("[图片 "), F.col("n").cast("string"), F.lit(" OCR 结果]\n"), mask_pii("text"))
    parts = read.groupBy("source", "msg_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("x"))
    return parts.select("source", "msg_id", F.array_join(F.transform("x", lambda p: p["t"]), "\n").alias("text"))


def enrich(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """A message of placeholders alone becomes the recognised text; other messages get it appended."""
    rows = messages.join(texts, ["source", "msg_id"], "left")
    new = F.when(is_placeholder_only(F.col("content")), F.concat(F.lit("[OCR]\n"), F.col("text"))).otherwise(F.concat("content", F.lit("\n[OCR]\n"), F.col("text")))
    return rows.withColumn("content", F.coalesce(new, "content")).drop("text")
