"""Near-duplicate decisions by rounds against a walk over the cards; runs, changes and remembered verdicts."""

import random
import re

from larkspur.operators import dedup
from larkspur.operators.survivors import NegativeVerdicts, SurvivorStore
from larkspur.schemas import Settings

SCHEMA = "seq long, source string, title string, source_quote string, image_urls array<string>, vec array<double>"


def overlap(a, b):
    a, b = a.replace(" ", ""), b.replace(" ", "")
    cut = (lambda t: {t[i : i + 2] for i in range(len(t) - 1)}) if len(a) > 1 and len(b) > 1 else set
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def same(a, b):
    return None if (a + b) % 17 == 0 else (a * 7 + b * 3) % 5 < 3


def judge(pairs):
    from pyspark.sql import functions as F

    s, c = F.col("seq"), F.col("cand_seq")
    return pairs.withColumn("same", F.when((s + c) % 17 != 0, (s * 7 + c * 3) % 5 < 3))


def walk(cards, s=Settings(), image_sources=None, alive=None):
    """One card after the other against the survivors so far."""
    alive, out = alive if alive is not None else [], {}
    for c in cards:
        seq, source, title, quote, images, vec = c
        images = sorted({u for u in images or [] if u.strip()})
        key = lambda x: sorted({u for u in x[4] or [] if u.strip()})
        image = next((x[0] for x in alive if images and (image_sources is None or source in image_sources) and x[1] == source and key(x) == images), None)
        text = next((x[0] for x in alive if quote and not re.match(r"^(?:\s*\[[^\]]+\])+\s*$", quote) and x[3] == quote), None)
        near = sorted(((-cosine(vec, x[5]), x[0]) for x in alive if cosine(vec, x[5]) >= min(s.dedup_fallback, s.dedup_cosine)))[: s.dedup_top_k]
        near = [(-v, n) for v, n in near]
        normal = [(v, n) for v, n in near if v >= s.dedup_cosine]
        how, hit, channel = None, None, None
        if image is not None or text is not None:
            hit, how, channel = (image, "image", "exact") if image is not None else (text, "hash", "exact")
        elif near and not normal:
            channel = "cosine"
            if all(same(seq, n) for _, n in near):
                hit, how = near[0][1], "weak"
        elif normal:
            channel = "cosine"
            if normal[0][0] >= s.dedup_strong and same(seq, normal[0][1]) is not None:
                if same(seq, normal[0][1]):
                    hit, how = normal[0][1], "strong"
                normal = normal[1:]
            voted = [(v, n) for v, n in normal if same(seq, n) is not None]
            if hit is None and voted and sum(v for v, n in voted if same(seq, n)) > sum(v for v, _ in voted) / 2:
                hit, how = next(n for _, n in voted if same(seq, n)), "vote"
        else:
            best = min(((-overlap(title, x[2]), x[0]) for x in alive), default=(0, None))
            if -best[0] >= s.dedup_overlap and best[0]:
                channel = "overlap"
                if same(seq, best[1]):
                    hit, how = best[1], "overlap"
        ran = channel != "exact" and bool(vec) and any(x[5] for x in alive)
        out[seq] = (hit, how, channel or ("cosine_no_candidate" if ran else "none"))
        if hit is None:
            alive.append(c)
    return out


def some_cards(n, seed):
    rng = random.Random(seed)
    words = ["hall", "open day", "lecture", "swim", "a", "x", "é", "", "讲座", "讲座 通知", "q z"]
    rows = []
    for i in range(n):
        centre = rng.randrange(9)
        v = [0.3 * rng.gauss(0, 1) + (3.0 if k == centre else 0.0) for k in range(9)]
        vec = None if rng.random() < 0.3 else [0.0] * 9 if rng.random() < 0.03 else v
        title = " ".join(rng.choice(words) for _ in range(rng.randrange(3)))
        quote = rng.choice([None, "", "[image] [x]", f"text {rng.randrange(60)}", f"text {rng.randrange(900)}"])
        images = rng.choice([None, [], [f"u{rng.randrange(9)}", f"u{rng.randrange(9)}"], ["u1", " "]]) if rng.random() < 0.4 else []
        rows.append((i, rng.choice(["album", "app"]), title, quote, images, vec))
    return rows


def result(df):
    return {r.seq: (r.duplicate_of, r.how, r.channel) for r in df.collect()}


def test_rounds_equal_a_walk(spark):
    cards = some_cards(160, 1)
    want = walk(cards, image_sources=("album",))
    got = result(dedup.decide(spark.createDataFrame(cards, SCHEMA), judge, image_sources=("album",)))
    assert got == want
    assert {v[1] for v in want.values()} >= {"image", "hash", "vote", "overlap", None}


def test_scopes_are_caches_of_their_own(spark):
    parts = {f"s{k}": some_cards(25, 10 + k) for k in range(4)}
    rows = [(*c, name) for name, cards in parts.items() for c in cards]
    found = dedup.decide(spark.createDataFrame(rows, SCHEMA + ", scope string"), judge)
    for name, cards in parts.items():
        assert result(found.where(found.scope == name)) == walk(cards)


def test_cells_and_blocks_of_cosine_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        c = rng.randrange(6)
        rows.append((i, [rng.gauss(0, 0.4) + (2 if k == c else 0) for k in range(6)]))
    df = spark.createDataFrame(rows, "seq long, vec array<double>")
    want = {(i, j) for i, a in rows for j, b in rows if j < i and cosine(a, b) >= 0.7}
    for block, centres in ((4096, 256), (20, 8), (50, 1)):
        got = [(r.seq, r.cand_seq) for r in dedup.cosine_pairs(df, 0.7, block, centres).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_two_runs_equal_one_and_cards_can_change(spark, tmp_path):
    cards = some_cards(120, 7)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = SurvivorStore(spark, f"file://{tmp_path}/survivors")
    got = result(store.run(frame(cards[:70]), judge)) | result(store.run(frame(cards[70:]), judge))
    alive = []
    assert got == walk(cards, alive=alive)
    assert {r.seq for r in store.survivors().collect()} == {c[0] for c in alive}
    # A removed card is no candidate, a rewritten one is compared as it is now, and a removed one can come back.
    gone, changed = alive[0], (*alive[1][:2], "rewritten title", "a new text", [], None)
    store.change(frame([gone]), frame([changed]))
    alive = [changed if c[0] == changed[0] else c for c in alive if c[0] != gone[0]]
    later = [(1000 + i, *c[1:]) for i, c in enumerate(some_cards(40, 8))] + [(1100, "app", "other", "a new text", [], None), (1101, "app", "zz", gone[3], [], gone[5])]
    assert result(store.run(frame(later), judge)) == walk(later, alive=alive)
    store.change(rewrite=frame([gone]))
    assert gone[0] in {r.seq for r in store.survivors().collect()}
    store.store.drop_older(1)
    assert len(store.store.numbers()) == 1


def test_denied_pairs_are_asked_once(spark, tmp_path):
    asked = []

    def counting(pairs):
        asked.append(sorted((r.seq, r.cand_seq) for r in pairs.collect()))
        return judge(pairs)

    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = [(0, "app", "open day in the hall", "q0", [], None), (1, "app", "swimming lesson", "q1", [], None)]
    repeat = lambda i, text: (i, "app", "open day in a hall", text, [], None)
    denied = next(i for i in range(5, 40) if same(i, 0) is False)
    again = next(i for i in range(denied + 1, 80) if same(i, 0) is not None)
    negatives = NegativeVerdicts(spark, f"file://{tmp_path}/negatives", most=50)
    store = SurvivorStore(spark, f"file://{tmp_path}/survivors", negatives)
    store.run(frame(first), counting)
    assert result(store.run(frame([repeat(denied, "t")]), counting))[denied][0] is None
    store.change(remove=frame([repeat(denied, "t")]))
    asked.clear()
    assert result(store.run(frame([repeat(again, "t")]), counting))[again] == (None, None, "overlap")
    assert [p for a in asked for p in a] == []
    # A rewritten candidate is asked about again.
    store.change(remove=frame([repeat(again, "t")]), rewrite=frame([(0, "app", "open day in the hall", "other", [], None)]))
    asked.clear()
    store.run(frame([repeat(again + 100, "t")]), counting)
    assert [p for a in asked for p in a] == [(again + 100, 0)]
    many = NegativeVerdicts(spark, f"file://{tmp_path}/many", most=3)
    ask = many.remember(lambda p: p.withColumn("same", p.seq < 0))
    pairs = spark.createDataFrame([("", i, 0, f"t{i}", "", "c", "") for i in range(9)], "scope string, seq long, cand_seq long, title string, quote string, cand_title string, cand_quote string")
    assert ask(pairs).where("same").count() == 0
    many.commit()
    assert many.store.newest().count() == 3


def test_query_equals_a_walk_over_its_cards(spark, sf, monkeypatch):
    from larkspur.plans import decisions
    from larkspur.plans.registry import QUERIES

    rows = sorted((r.seq, r.source, r.title, r.source_quote, r.image_urls, r.vec) for r in decisions.dedup_cards(spark, sf).collect())
    titles = {r[0]: r[2] for r in rows}
    monkeypatch.setitem(globals(), "same", lambda a, b: titles[a][:5].strip() == titles[b][:5].strip())
    want = walk(rows, Settings(dedup_cosine=0.45, dedup_fallback=0.35))
    got = {r.seq: (r.duplicate_of, r.how, r.channel) for r in QUERIES["greedy_dedup"](spark, sf).collect()}
    assert got == want and len({v[2] for v in want.values()}) >= 3


def test_lists_of_nearest_cards_are_short_and_enough(spark, monkeypatch):
    """Of a cluster of near copies only a few pairs a card are written, and a list whose cards are all dead is not the last word."""
    rng = random.Random(5)
    cards = [(i, "app", f"t{i}", f"text {i}", [], [1.0, *(0.4 * rng.gauss(0, 1) for _ in range(5))]) for i in range(90)]
    df, rows = spark.createDataFrame(cards, SCHEMA), {}
    keep = dedup.written

    def counted(table, name):
        out = keep(table, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    for c in cards[::15]:
        want = sorted((-cosine(c[5], o[5]), o[0]) for o in cards if o[0] < c[0] and cosine(c[5], o[5]) >= 0.5)[:4]
        got = dedup.cosine_pairs(df, 0.5, 16, 4, most=4).where(f"seq = {c[0]}").orderBy("score", ascending=False).collect()
        assert [r.cand_seq for r in got] == [n for _, n in want]
    monkeypatch.setattr(dedup, "written", counted)
    settings = Settings(dedup_cosine=0.7, dedup_fallback=0.6, dedup_top_k=2)
    monkeypatch.setattr(dedup, "NEAREST", 2)
    assert result(dedup.decide(df, judge, settings=settings)) == walk(cards, settings)
    assert rows["dedup-pairs"] <= 8 * len(cards) and rows["dedup-short"] > 0


def test_equal_vectors_come_by_number(spark):
    rng = random.Random(9)
    v = [rng.gauss(0, 1) for _ in range(67)]
    df = spark.createDataFrame([(i, [x * (1 + i % 7) for x in v]) for i in range(120)], "seq long, vec array<double>")
    for block in (7, 64):
        got = dedup.cosine_pairs(df, 0.5, block, 3, most=5).where("seq >= 5").groupBy("seq").agg({"cand_seq": "max", "score": "min"}).collect()
        assert len(got) == 115 and {(r[1], r[2]) for r in got} in ({(4, 1.0)}, {(1.0, 4)})
