"""Benchmark runners against a run case by case; classification answers with every fault."""

import json
import random

from larkspur.operators import classify, dedup, runners
from larkspur.ports.ai import Cut, StubProvider, embed
from larkspur.schemas import Settings
from tests.test_dedup import walk

CARD = "struct<title:string,source_quote:string,source:string,image_urls:array<string>>"


def judge(pairs):
    from pyspark.sql import functions as F

    return pairs.withColumn("same", F.substring("title", 1, 3) == F.substring("cand_title", 1, 3))


def test_dedup_cases_equal_a_run_each(spark):
    rng = random.Random(12)
    words = ["open day", "swim", "lecture hall", "a", "讲座 通知", "market"]
    card = lambda: (" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3))), rng.choice(["", "[x]", f"text {rng.randrange(8)}"]), rng.choice(["album", "app"]), rng.choice([[], [f"u{rng.randrange(3)}"]]))
    rows = [(f"c{i}", [card() for _ in range(rng.randrange(0, 5))], card(), rng.random() < 0.5) for i in range(40)]
    cases = spark.createDataFrame(rows, f"case_id string, items array<{CARD}>, query {CARD}, same boolean")
    settings = Settings(dedup_cosine=0.6, dedup_fallback=0.3)
    got = {r.case_id: r for r in runners.run_dedup(cases, StubProvider, settings, ("album",), judge).collect()}
    assert len(got) == len(rows)

    def alone(row):
        one = cases.where(cases.case_id == row[0])
        r = runners.run_dedup(one, StubProvider, settings, ("album",), judge).first()
        return (r.predicted, r.channel, r.cosine_ran, r.skipped)

    for row in rows[:3]:
        assert (got[row[0]].predicted, got[row[0]].channel, got[row[0]].cosine_ran, got[row[0]].skipped) == alone(row)
    # And the plain walk over each case's cards, which stay whatever they are to each other.
    stub = StubProvider()
    import tests.test_dedup as plain

    before = plain.same
    try:
        for case, items, query, _ in rows:
            titles = {**{i: c[0] for i, c in enumerate(items)}, 99: query[0]}
            plain.same = lambda a, b, t=titles: t[a][:3] == t[b][:3]
            full = lambda i, c: (i, c[2], c[0], c[1], c[3], stub.embed([f"{c[0]} {c[1]}"])[0])
            hit, _, channel = walk([full(99, query)], settings, ("album",), [full(i, c) for i, c in enumerate(items)])[99]
            assert (got[case].predicted, got[case].channel) == (hit is not None, channel), case
    finally:
        plain.same = before
    assert len({r.channel for r in got.values()}) >= 4
    report = runners.dedup_report(runners.run_dedup(cases, StubProvider, settings, ("album",), judge)).first()
    assert report.tp + report.fp + report.tn + report.fn == len(rows) and report.channel_exact == sum(r.channel == "exact" for r in got.values())


class Faulty:
    """Answers by what a message says."""

    def chat(self, prompts):
        out = []
        for prompt in prompts:
            part, names, *lines = prompt.split("\n")
            entries = []
            for line in lines:
                i, text = line[1:].split("] ", 1)
                kind = text.split()[0] if text else "plain"
                if kind == "gap" or (kind == "once" and not part.startswith("again")):
                    continue
                entries.append({"index": int(i), "category": {"unknown": "zz", "list": ["a"]}.get(kind, names.split("|")[0]), "key": "k", "quote": 5})
                if kind == "out":
                    entries[-1]["include"] = "false"
                if kind == "far":
                    entries[-1]["index"] = 99
                if kind == "twice":
                    entries.append(entries[-1])
            if any("down" in x for x in lines):
                out.append(None)
            elif len(lines) > 4 or any("long" in x for x in lines):
                out.append(Cut(json.dumps(entries)))
            else:
                out.append(json.dumps(entries) if part else "words " + json.dumps({"data": entries}) + " words")
        return out

    def embed(self, texts):
        return [None] * len(texts)


def test_classification_outcomes(spark):
    batches = {
        "halved": ["plain"] * 3 + ["once", "gap", "unknown", "list", "out", "plain", "once"],
        "far": ["plain", "far"],
        "twice": ["plain", "twice"],
        "down": ["plain", "down"],
        "long": ["plain", "plain", "long", "plain"],
        "empty": [None],
    }
    rows = [(b, i, None if t is None else f"{t} text") for b, texts in batches.items() for i, t in enumerate(texts)]
    got = {(r.batch_id, r.seq): (r.status, r.reason) for r in classify.classify_messages(spark.createDataFrame(rows, "batch_id string, seq long, content string"), Faulty, ["a", "b"]).collect()}
    assert len(got) == len(rows)
    want = {"plain": ("include", None), "once": ("include", None), "gap": ("failed", "missing"), "unknown": ("failed", "unknown category"), "list": ("failed", "unknown category"), "out": ("exclude", None)}
    assert [got["halved", i] for i in range(10)] == [want[t] for t in batches["halved"]]
    assert {got[b, i] for b in ("far", "twice", "down") for i in range(2)} == {("failed", "unreadable")}
    assert [got["long", i][0] for i in range(4)] == ["include", "include", "failed", "include"] and got["empty", 0] == ("include", None)


def test_depth_bounds_the_halving(spark):
    rows = [("b", i, "plain") for i in range(40)]
    df = spark.createDataFrame(rows, "batch_id string, seq long, content string")
    status = lambda depth: {r.status for r in classify.classify_messages(df, Faulty, ["a"], depth).collect()}
    assert status(6) == {"include"} and status(2) == {"failed"}


def test_merge_and_title_runners(spark):
    side = "struct<title:string,content:string>"
    rows = [(1, ("a", "x"), ("a", "x"), True), (2, ("a", "x"), ("b", "quite another text"), False), (3, ("", ""), ("", ""), True)]
    cases = spark.createDataFrame(rows, f"case_id long, head {side}, tail {side}, merge boolean")
    got = {r.case_id: (r.predicted, r.skipped, r.error) for r in runners.run_merge(cases, StubProvider).collect()}
    assert got[1] == (True, False, None) and got[2] == (False, False, None)
    low = {r.case_id: (r.predicted, r.skipped) for r in runners.run_merge(cases, StubProvider, Settings(merge_prefilter=0.9)).collect()}
    assert low[1] == (True, False) and low[2] == (False, True)

    class Silent(StubProvider):
        def chat(self, prompts):
            return [None] * len(prompts)

    assert {(r.predicted, r.error) for r in runners.run_merge(cases, Silent).collect()} == {(False, "the judge gave no verdict")}
    titles = spark.createDataFrame([(1, "old", "Open day\nin the hall", "Open days", ["Open"]), (2, "old one", "", "x", [])], "case_id long, old_title string, content string, expected_title string, keywords array<string>")
    got = {r.case_id: (r.title, r.fallback) for r in runners.run_title(titles, StubProvider).collect()}
    assert got == {1: ("Open day", False), 2: ("old one", True)}


def test_dedup_cases_take_few_steps(spark, monkeypatch):
    """The driver holds the plan of each step, so its memory grows with the steps: a case with one new card needs no rounds."""
    plans = []
    for module in (dedup, runners):
        keep = module.written
        monkeypatch.setattr(module, "written", lambda df, name, keep=keep: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    rows = [("c0", [("open day", "text", "app", [])], ("open day", "text", "app", []), True), ("c1", [("swim", "a", "app", ["u"])], ("open", "b", "app", []), False)]
    cases = spark.createDataFrame(rows, f"case_id string, items array<{CARD}>, query {CARD}, same boolean")
    report = runners.dedup_report(runners.run_dedup(cases, StubProvider, judge=judge))
    plans.append(report._jdf.queryExecution().executedPlan().toString())
    assert (report.first().tp, report.first().tn) == (1, 1)
    assert len(plans) <= 4 and sum(p.count("Exchange ") for p in plans) <= 12
