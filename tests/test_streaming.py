"""Streams equal batches: ingest, frames, the session source."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.sources.poll import SessionSource
from larkspur.streaming.ingest import PROCESSED, RAW, StageChain, Store, listen, start_ingest

MESSAGES = "source string, msg_id string, session_id string, content string, timestamp long, is_self boolean, image_urls array<string>"


def test_available_now_equals_batch_and_repeats_are_stored_once(spark, tmp_path):
    rows = [("app", f"m{i % 30}", f"s{i % 3}", f"text {i % 30}", i % 30, i % 10 == 0, []) for i in range(60)]
    source = tmp_path / "in"
    for n in (0, 30):
        spark.createDataFrame(rows[n : n + 30], MESSAGES).write.mode("append").json(str(source))
    sessions = spark.createDataFrame([("app", "s0", 1), ("app", "s1", 1), ("app", "s2", 0)], "source string, session_id string, enabled int")
    chain = StageChain()
    chain.register("pre_insert", "upper", lambda df: df.withColumn("content", F.upper("content")))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).json(str(source))
        start_ingest(stream, store, sessions, chain, str(tmp_path / "cp")).awaitTermination(120)
    want = {r[1] for r in rows if not r[5] and r[2] != "s2"}
    got = [r.msg_id for r in store.read("raw", RAW).collect()]
    assert sorted(got) == sorted(want)
    assert {r.msg_id for r in store.read("processed", PROCESSED).collect()} == want
    assert all(r.content.isupper() or not r.content.isalpha() for r in store.read("items", RAW).collect())


def test_listener_drops_repeats_and_control_events(spark, tmp_path):
    lines = [{"value": "data: " + json.dumps({"event": "msg", "rawid": str(i % 4), "content": "x"}), "arrived": f"2024-01-01T00:00:{i:02d}"} for i in range(12)]
    lines.append({"value": 'data: {"event":"ping"}', "arrived": "2024-01-01T00:00:20"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.schema("value string, arrived timestamp").json(str(tmp_path / "in"))
    q = listen(stream).writeStream.format("memory").queryName("heard").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.rawid for r in spark.table("heard").collect()) == ["0", "1", "2", "3"]


def test_stage_order():
    chain = StageChain()
    chain.register("pre_insert", "b", lambda d: d, 0, after=("a",))
    chain.register("pre_insert", "a", lambda d: d, 5)
    chain.register("pre_insert", "c", lambda d: d, -1)
    assert chain.order("pre_insert") == ["c", "a", "b"]
    chain.register("pre_insert", "x", lambda d: d, after=("y",))
    chain.register("pre_insert", "y", lambda d: d, after=("x",))
    with pytest.raises(ValueError):
        chain.order("pre_insert")


def test_session_source(spark):
    spark.dataSource.register(SessionSource)
    df = spark.read.format("chat_sessions").option("client", "tests.poll_client:client").option("sessions", "a,b,bad").option("since", "a=20,b=0").option("page", "10").load()
    n = {r.session_id: r.n for r in df.where("NOT failed").groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 6, "b": 25}
    assert [r.session_id for r in df.where("failed").collect()] == ["bad"]
