"""Scalar functions: masking, times, JSON, text measures."""

import datetime as dt
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import jsonx, text, times, vectors


def one(spark, column, **values):
    ddl = ", ".join(f"`{k}` {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], ddl).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [
    ("联系138-0013-8000谢谢", "联系[PHONE]谢谢"),
    ("138 0013 8000 找我", "[PHONE] 找我"),
    ("时间戳 1700000000 保留", "时间戳 1700000000 保留"),
    ("110101900101123+13800138000", "[ID]+[PHONE]"),
    ("１３８００１３８０００", "[PHONE]"),
    ("mail a.b@c.example or sk-abcdefghijklmnop1234", "mail [EMAIL] or [TOKEN]"),
    ("12 13 14 15 16 17 18 19", "12 13 14 15 16 17 18 19"),
    ("6222 0202 0000 0000 000", "[BANKCARD]"),
    ("+86 138 0013 8000", "[PHONE]"),
    ("2024-01-15 138-0013-8000", "2024-01-15 [PHONE]"),
    ("110101199001011234", "[ID]"),
    (None, ""),
])
def test_masking(raw, want):
    assert text.mask_text(raw) == want
    assert text.mask_text(want) == want


def test_masking_is_idempotent_on_random_text():
    random.seed(4)
    parts = ["1", "86", "138", "0013", "8000", "-", " ", "+", "@x.org", "a", "第", "　", "１", "110101"]
    for _ in range(3000):
        once = text.mask_text("".join(random.choice(parts) for _ in range(random.randint(0, 14))))
        assert text.mask_text(once) == once


def test_masking_column(spark):
    df = spark.createDataFrame([("call 13800138000",), (None,)], "t string")
    assert sorted(r.m for r in df.select(text.mask_pii("t").alias("m")).collect()) == ["", "call [PHONE]"]


def overlap(a, b):
    a, b = a.replace(" ", ""), b.replace(" ", "")
    grams = (lambda s: set(s)) if len(a) < 2 or len(b) < 2 else (lambda s: {s[i : i + 2] for i in range(len(s) - 1)})
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def test_title_overlap(spark):
    random.seed(1)
    pairs = [("摄影社招新", "摄影社招新"), ("abc", "xyz"), ("", "abc"), ("好", "好"), ("好", "坏"), ("a b", "ab c")]
    pairs += [("".join(random.choice("abc 社") for _ in range(random.randint(0, 7))), "".join(random.choice("abc 社") for _ in range(random.randint(0, 7)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.title_overlap(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r.s == pytest.approx(overlap(r.a, r.b)), r


def test_text_helpers(spark):
    assert one(spark, text.fold_ascii(F.col("s")), s="ABCÉ") == "abcÉ"
    assert one(spark, text.contains_folded(F.col("s"), "A%_b"), s="xa%_By") is True
    assert one(spark, text.clean_display_name(F.col("s")), s="\x01\x01 Ann \t") == "Ann"
    assert one(spark, text.is_placeholder_only(F.col("s")), s=" [图片][图片] ") is True
    assert one(spark, text.is_placeholder_only(F.col("s")), s="[图片] text") is False
    assert one(spark, text.split_keywords(F.col("s")), s="a，b、 c,,") == ["a", "b", "c"]
    assert one(spark, text.context_text(F.col("c"), F.col("q")), c="[图片]", q="[OCR]\n[图片 1 OCR 结果]\nreal text") == "real text"
    assert one(spark, text.csv_cell(F.col("s")), s="=1+1") == "'=1+1"
    assert one(spark, text.redact_query(F.col("s")), s="/a?x=1&access_token=abc&y=2") == "/a?x=1&access_token=***&y=2"
    assert one(spark, text.media_path(F.col("s")), s="http://h:1/api/v1/media/p/q.png?x=1") == "p/q.png" and one(spark, text.media_path(F.col("s")), s="http://h:1/p/q.png") is None
    assert one(spark, text.digest(F.col("s")), s="abc") == "ba7816bf8f01cfea"
    assert one(spark, text.normalize_subject("s"), s="ＡＣＭ　 竞赛 ") == "acm 竞赛"
    assert one(spark, text.containment("a", "b"), a="b c d", b="abcde") == 1.0
    assert one(spark, text.title_similarity("a", "b"), a="abcd", b="bcde") == pytest.approx(0.75)


@pytest.mark.parametrize(("said", "anchor", "want"), [
    ("下周三开会", "2026-10-28", ["2026-11-04"]),
    ("周三开会", "2026-10-28", ["2026-10-28"]),
    ("2026-02-30 出发", "2026-01-01", []),
    ("2027年5月1日集合", "2026-01-01", ["2027-05-01"]),
    ("1月2日见", "2026-12-30", ["2027-01-02"]),
    ("下周三开会", None, []),
])
def test_chinese_dates(said, anchor, want):
    assert times.dates_in(said, dt.date.fromisoformat(anchor) if anchor else None) == want


def test_hints():
    assert [(h["pattern_id"], h["clock"]) for h in times.hints_in("5月1日 下午3点 4.15")] == [(1, False), (4, True), (-1, False)]
    assert times.hints_in("尽快处理") == [] and len(times.hints_in("尽快，明天")) == 1


def test_stored_times(spark):
    now = F.lit("2024-01-15 12:00").cast("timestamp")
    empty = F.lit(None).cast(times.TIME_POINTS)
    case = lambda s, e: one(spark, times.item_is_expired(F.col("s"), F.col("e"), empty, now), s=s, e=e)
    assert case(None, "2024-01-15 11:59") is True and case(None, "2024-01-15") is False and case(None, "2024-01-14") is True
    assert case("2024-01-16", "2024-01-14") is False and case("2024-01-10", None) is False and case(None, "not a time") is False
    assert one(spark, times.clean_time(F.col("s")), s=" 2024-02-30 ") == "" and one(spark, times.clean_time(F.col("s")), s="2024-02-29 10:00") == "2024-02-29 10:00"
    assert one(spark, times.coerce_epoch(F.col("s")), s="1970-01-02 00:00") == 86400 and one(spark, times.coerce_epoch(F.col("s")), s="12") == 12 and one(spark, times.coerce_epoch(F.col("s")), s="x") is None and one(spark, times.bad_time(F.col("s")), s="x") is True
    assert one(spark, times.is_echo(F.col("t"), F.col("e")), t="1970-01-02", e=86400) is True
    assert one(spark, times.reminder_minute(F.col("s")), s="2024-01-01T10:00+02:00") == "2024-01-01 08:00"
    assert one(spark, times.backoff_seconds(F.col("n")), n=2) == 240.0


def test_hint_resolution(spark):
    points = F.array(F.lit("2026-05-13"), F.lit("2026-05-13 15:30"))
    ok = lambda h, clock, t=points: one(spark, times.hint_resolved(F.lit(h), F.lit(clock), t))
    assert ok("5月13日", False) and ok("2026-5-13", False) and ok("下午3点30分", True) and ok("3点", True)
    assert not ok("5月3日", False) and not ok("12:30", True) and not ok("下午3点", True, F.array(F.lit("2026-05-13")))


def test_json(spark):
    assert jsonx.json_root('Sure:\n```json\n{"a": [1]}\n```') == '{"a": [1]}' and jsonx.json_root("none") is None
    assert one(spark, jsonx.string_set(F.col("s")), s='["b","a","b"]') == ["a", "b"] and one(spark, jsonx.string_set(F.col("s")), s="oops") == []
    got = one(spark, jsonx.time_points(F.col("s")), s='[{"type":"end","time":"2024-01-01","label":"x"},{"type":"end","time":"2024-01-01"},{"type":"no","time":"2024-01-01"},{"type":"start","time":"bad"}]')
    assert [(p["type"], p["time"], p["label"]) for p in got] == [("end", "2024-01-01", "x")]
    assert one(spark, jsonx.vector(F.col("s")), s="[1,2.5]") == [1.0, 2.5] and one(spark, jsonx.vector(F.col("s")), s="[1,") is None
    assert one(spark, jsonx.parse_verdict(F.col("s")), s='ok {"same": true}') is True and one(spark, jsonx.parse_verdict(F.col("s")), s="?") is None
    assert one(spark, jsonx.citations(F.col("s"), F.lit(3)), s="yes [2] and [7], [2] [1]") == [2, 1]
    assert one(spark, jsonx.parse_title(F.col("s")), s='{"title": "A title"}') == "A title"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0]


def test_patterns_have_no_lookalike_digits():
    assert re.fullmatch(text.PLACEHOLDER_ONLY, "[a] [b]")


def test_model_answers(spark):
    ask = lambda f, *texts: [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    plain = lambda m: None if m is None else {k: tuple(v) if hasattr(v, "asDict") else [tuple(p) for p in v] for k, v in m.items()}
    got = ask(
        jsonx.parse_summaries,
        '{"task":"summarize","data":[{"index":1,"summary":" a \\n b ","subject":" s "},{"index":true,"summary":"x"},"dirt",{"index":"2","summary":"x"},{"index":3,"summary":5,"subject":""},{"index":1,"summary":"later"}]}',
        '```json\n[{"index":4,"subject":"only"}]\n```', "no list here", None,
    )
    assert [plain(m) for m in got] == [{1: ("later", "")}, {4: ("", "only")}, {}, {}]
    got = ask(
        jsonx.parse_times,
        '{"task":"times","data":[{"index":0,"times":[{"type":"start","time":"2026-03-01","label":" a  b "},{"type":"x","time":"2026-03-01"},{"type":"end","time":"2026-13-01"},7]},{"index":1,"times":[]},{"index":2,"times":"no"}]}',
        '{"task":"times","data":[]}', '{"task":"summarize","data":[]}', '{"data":3}', "words", '[{"index":5,"times":[{"type":"end","time":"2026-03-01 10:00","label":null}]}]',
    )
    assert [plain(m) for m in got] == [{0: [("start", "2026-03-01", "a b")], 1: []}, {}, None, None, None, {5: [("end", "2026-03-01 10:00", "")]}]
    got = ask(
        lambda c: jsonx.cited_answer(c, F.lit(3)),
        '{"answer":" yes ","citations":[3, 1.0, "2", true, 9, 1.5, null, "x"]}', '{"answer":"yes","citations":[]}', '{"answer":"yes [2]"}', "so it is [3] and [1] and [7]", "plain", '{"answer":" ","citations":[1]}',
    )
    assert [tuple(r) for r in got] == [("yes", [1, 2, 3], False), ("yes", [], False), ("yes [2]", [2], False), ("so it is [3] and [1] and [7]", [1, 3], False), ("plain", [1, 2, 3], False), ("", [], True)]


def test_masking_query_equals_the_plain_function(spark, sf):
    """The filter before Python loses nothing: every text of the table, masked without it."""
    from larkspur.plans.registry import QUERIES, load

    load()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.masked for r in QUERIES["mask_pii"](spark, sf).collect()}
    assert got == {i: text.mask_text(t) for i, t in docs.items()} and any(got[i] != t for i, t in docs.items())


def test_subjects_equal_the_plain_rule_and_ascii_stays_out_of_python(spark):
    random.seed(6)
    plain = lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip().lower() if x else ""
    parts = [*map(chr, range(128)), "  ", "\r\n", "A b", "Ａ", "　", "\u00a0", "\x85", "İ", "ΣΑΣ", "ﬁ", "é", "e\u0301", "𝒳"]
    said = [None, "", " ", " \t", "x" * 300_000 + "É"] + ["".join(random.choice(parts[: 131 if i % 2 else None]) for _ in range(random.randrange(30))) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    assert {r.i: r.s for r in df.select("i", text.normalize_subject("t").alias("s")).collect()} == {i: plain(t or "") for i, t in enumerate(said)}
    given = df.where("i % 2 = 1").select(text.normalize_subject("t").alias("s"))
    assert "ArrowEvalPython [_subjects(CASE WHEN" in given._jdf.queryExecution().executedPlan().toString()
    texts = pa.array(["é" * 400_000, None, "", "B", "é" * 900_000, "Ｃ"])
    assert [a.to_pylist() for a in text._subjects.func(iter([texts, texts.slice(0, 0)]))] == [["é" * 400_000, None, "", "b", "é" * 900_000, "c"], []]


@pytest.mark.parametrize("name", ["summary_answers", "time_answers"])
def test_answers_are_dealt_and_read_once(spark, sf, name):
    from larkspur.plans.registry import QUERIES, load

    load()
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Filter (size(" not in plan and "Filter ((size(" not in plan


def test_a_list_by_index_names_its_entries_once(spark):
    plan = spark.range(1).select(jsonx._by_index(F.array(F.struct(F.col("id").alias("index"), F.lit("mark-of-entry").alias("value")))).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("mark-of-entry") == 1
