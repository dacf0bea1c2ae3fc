"""The metrics sink: repeated batches, throttle, empty snapshots, retention, and a stream that feeds it."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from larkspur.sources.metrics_sink import MetricsSink

NOW = datetime(2026, 3, 20, 12, 0, 0)


def test_snapshots_and_decisions(spark, tmp_path):
    sink = MetricsSink(spark, f"file://{tmp_path}/sink")
    counts = lambda n: spark.createDataFrame([("ai", n)], "kind string, n long")
    told = lambda *rows: spark.createDataFrame(list(rows), "seq long, cosine double, ts timestamp")
    assert sink.latest() is None
    first = told((1, 0.5, NOW), (2, 0.7, NOW - timedelta(days=1)), (3, 0.1, None))
    assert sink.flush(0, NOW, counts(5), first)
    assert not sink.flush(0, NOW + timedelta(seconds=10), counts(6), first)  # done again, within the interval
    assert sink.log("decisions").count() == 3 and sink.latest().first()["n"] == 5
    assert sink.flush(1, NOW + timedelta(seconds=40), counts(7), told((4, 0.2, NOW)))
    assert sink.log("decisions").count() == 4 and sink.latest().first()["n"] == 7
    assert not sink.flush(2, NOW + timedelta(seconds=90), counts(0).where("n > 0"))  # empty: earlier readings stay
    assert sink.latest().first()["n"] == 7 and sorted(r["n"] for r in sink.log("snapshots").collect()) == [5, 7]
    # Snapshots go after 14 days, decisions after 180; one without a time stays.
    assert sink.prune(date(2026, 4, 3)) == []
    assert sink.prune(date(2026, 4, 4)) == ["snapshots/day=2026-03-20"]
    assert sorted(sink.prune(NOW.date() + timedelta(days=181))) == ["decisions/day=2026-03-19", "decisions/day=2026-03-20"]
    assert [r["seq"] for r in sink.log("decisions").collect()] == [3] and sink.latest().first()["n"] == 7


def test_a_stream_feeds_it(spark, tmp_path):
    source = f"{tmp_path}/in"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("seq"), F.lit(NOW).alias("ts")).coalesce(1).write.mode("append").parquet(source)
    sink = MetricsSink(spark, f"file://{tmp_path}/sink")

    def body(rows, batch):
        sink.flush(batch, NOW + timedelta(minutes=batch), rows.agg(F.max("seq").alias("top")), rows)
        sink.flush(batch, NOW + timedelta(minutes=batch), None, rows)

    stream = spark.readStream.schema("seq long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["seq"] for r in sink.log("decisions").collect()) == list(range(30)) and sink.log("snapshots").count() == 3
