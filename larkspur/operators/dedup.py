"""Near-duplicate decisions over cards, in order, with an injected judge.

A card is compared with the cards that survived before it: a duplicate never becomes a candidate. Its channels, in order:
equal image sets (of one source that allows it), equal text hashes (placeholder texts aside), the nearest survivors by
cosine with a vote of the judge, and, where cosine gives none, the survivor of the highest title overlap.

Which cards survive is found by rounds over whole tables instead of a walk: all cards decide at once against an assumed set
of survivors (at first all), the outcome is the next assumption, and so on until nothing changes. A card's outcome depends
on earlier cards only, so after round r every card whose chain of dependence has at most r links is right, and the set that
reproduces itself is the one that the walk gives. Rounds are joins dealt by card or key; nothing is gathered by group.

Every table has a `scope`: cards of different scopes never meet. A store is one scope; benchmark cases are one each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import bigrams, digest, is_placeholder_only, judge_key, title_overlap
from larkspur.operators.neighbours import units
from larkspur.schemas import Settings
from larkspur.scratch import written

Judge = Callable[[DataFrame], DataFrame]
#: Vectors of a cell, where cells exclude many pairs.
BLOCK = 4096
#: Bytes of vectors that one task holds while others stream past them, and cells of their product at a time.
HELD = 1 << 25
TILE = 1 << 21
#: From this cosine on, cells are kept small: below it the triangle inequality excludes hardly a cell.
NARROW = 0.7
#: Tasks that meet one block of vectors, at most.
LOTS = 16
#: Earlier cards that are kept for a card, dead or alive.
NEAREST = 16
#: Vectors that cells are drawn around; the most that a task keeps of them.
CENTRES = 256
#: Scopes whose rows may be broadcast.
SCOPES = 100_000
_PAIR = ["scope", "seq", "cand_seq"]


def exact_pairs(cards: DataFrame) -> DataFrame:
    """(seq, cand_seq, channel, key): each card with the first of its equal group, by image set (one source) or text hash.

    A row per card, not per pair: `resolve` finds the earliest survivor of a group while it goes through it in order.
    """

    def pairs(key: list[str], name: str, rows: DataFrame) -> DataFrame:
        first = rows.groupBy(*key).agg(F.min("seq").alias("cand_seq"))
        return rows.join(first, key).where("seq > cand_seq").select("seq", "cand_seq", F.lit(name).alias("channel"), F.concat_ws("\x00", F.lit(name), *key).alias("key"))

    images = cards.where(F.size("image_urls") > 0).withColumn("image_key", F.array_join(F.array_sort(F.array_distinct("image_urls")), "\x00"))
    hashed = cards.where(F.coalesce("content_hash", F.lit("")) != "")
    return pairs(["source", "image_key"], "image", images).unionByName(pairs(["content_hash"], "hash", hashed))


def _by_scope(table: DataFrame) -> DataFrame:
    """A table with a row a scope, for a join by scope: one store is one row, and a large scope must not meet in one task. Beyond
    SCOPES rows no scope is large against the rest, or the adaptive plan splits it."""
    table = written(table, "scopes")
    return F.broadcast(table) if table.count() <= SCOPES else table


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (scope, seq, vec) of one length with `angles` to all centres."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            found = np.arccos(np.clip(units(batch.column("vec")) @ shared.value.T, -1, 1))
            ends = pa.array(np.arange(0, found.size + 1, len(shared.value)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*batch.schema.names, "angles"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(angles, f"{fields}, angles array<double>")


def cosine_pairs(cards: DataFrame, minimum: float, block: int | None = None, centres: int = CENTRES, most: int | None = None) -> DataFrame:
    """(scope, seq, cand_seq, score): each card with every earlier one of its scope whose cosine is at least `minimum` (over 0); with
    `most`, with that many of the highest cosine, the earlier of equals first.

    cards: seq, vec and, where there are, scope, `fresh` (whether it asks; two cards that are not fresh are no pair) and `held`
    (whether others may find it). Each vector lies in the cell of its nearest centre (a few vectors of the table). A card visits the
    cells that can hold a partner: by the triangle inequality those whose centre is no farther than the cell's radius plus the angle
    of `minimum`. A cell is dealt out in blocks of about `block` vectors, so a dense cell spreads over tasks, and a block's visitors in
    lots. Cards without a vector, zero vectors and vectors of another length pair with nothing.
    """
    scope = F.col("scope") if "scope" in cards.columns else F.lit("")
    flags = [(F.col(c) if c in cards.columns else F.lit(True)).alias(c) for c in ("fresh", "held")]
    rows = cards.where("size(vec) > 0").select(scope.alias("scope"), "seq", "vec", *flags).where(F.exists("vec", lambda x: x != 0))
    found = None
    # Lengths of vectors: one or two.
    for dim, n, asking in rows.groupBy(F.size("vec")).agg(F.count("*"), F.count_if("fresh")).collect():
        pairs = _pairs_of_length(rows.where(F.size("vec") == dim), n, asking, minimum, block or max(1024, HELD // 8 // dim), centres, block or BLOCK, most)
        found = pairs if found is None else found.unionByName(pairs)
    return rows.select("scope", "seq", F.col("seq").alias("cand_seq"), F.lit(0.0).alias("score")).limit(0) if found is None else found


def _pairs_of_length(rows: DataFrame, n: int, asking: int, minimum: float, block: int, centres: int, cell: int, most: int | None) -> DataFrame:
    around = rows.orderBy(F.xxhash64("seq", "scope")).limit(max(1, min(centres, n // (cell if minimum >= NARROW else block) + 1)))
    placed = _celled(rows, units(pa.array([r["vec"] for r in around.select("vec").collect()])))  # at most `centres` vectors
    nearest = F.array_position("angles", F.array_min("angles")).cast("int") - 1
    placed = written(placed.withColumn("cell", nearest).withColumn("radius", F.array_min("angles")), "cells")
    sizes = placed.where("held").groupBy("scope", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    # What a card can meet in its scope, a row a scope: its cells with their radius and blocks, `centres` at most.
    cells = sizes.groupBy("scope").agg(F.collect_list(F.struct("cell", "radius", "blocks")).alias("cells"))
    reach = float(np.arccos(min(1.0, max(-1.0, minimum)))) + 1e-7
    met = placed.join(_by_scope(cells), "scope")
    can = F.filter("cells", lambda c: F.element_at(F.col("angles"), c["cell"] + 1) <= c["radius"] + reach)
    lots = max(1, min(LOTS, asking // BLOCK))
    visits = met.where("fresh").select("scope", "seq", "vec", F.explode(can).alias("c")).select("scope", "seq", "vec", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)).alias("part"), F.pmod(F.xxhash64("seq", "scope"), F.lit(lots)).cast("int").alias("lot"), F.lit(True).alias("visit"))
    homes = met.where("held").select("scope", "seq", "vec", "cell", F.pmod(F.xxhash64("seq"), F.element_at(F.filter("cells", lambda c: c["cell"] == F.col("cell")), 1)["blocks"]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.lit(False).alias("visit"))
    key = ["scope", "cell", "part", "lot"]
    dealt = homes.unionByName(visits).repartition(*key).sortWithinPartitions(*key, "visit", "seq")
    dealt = dealt.select(F.xxhash64(*key).alias("home"), "visit", "scope", "seq", "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, names = None, [], []
        for batch in (b for b in batches if b.num_rows):
            keys, visit = batch.column("home").to_numpy(), batch.column("visit").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (visit[1:] != visit[:-1])]))
            for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
                part = batch.slice(lo, hi - lo)
                if keys[lo] != home:
                    home, held, names = keys[lo], [], []
                v, seq = units(part.column("vec")), part.column("seq").to_numpy(zero_copy_only=False)
                if not visit[lo]:
                    held.append(v)
                    names.append(seq)
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held, names = [np.concatenate(held)], [np.concatenate(names)]
                m, own = held[0], names[0]
                rows = max(16, min(512, TILE // len(own)))
                for at in range(0, len(v), rows):
                    mine = seq[at : at + rows]
                    earlier = int(np.searchsorted(own, mine[-1]))  # both sides come by seq
                    sims = v[at : at + rows] @ m[:earlier].T
                    x, y = np.nonzero(sims >= minimum)
                    before = own[y] < mine[x]
                    x, y = x[before], y[before]
                    score = np.round(sims[x, y], 12)  # a product's last bits depend on the block, and equals must stay equal from round to round
                    if most is not None and len(x):
                        order = np.lexsort((own[y], -score, x))
                        order = order[np.arange(len(x)) - np.searchsorted(x, x) < most]
                        x, y, score = x[order], y[order], score[order]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([part.column("scope").take(pa.array(x + at)), pa.array(mine[x]), pa.array(own[y]), pa.array(score)], [*_PAIR, "score"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("scope", "seq")]
    pairs = dealt.mapInArrow(meet, f"scope {kinds[0]}, seq {kinds[1]}, cand_seq {kinds[1]}, score double")
    return pairs if most is None else _ranked(pairs).where(F.col("rank") <= most).drop("rank")


def _ranked(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "seq").orderBy(F.desc("score"), "cand_seq")))


def _title_keys(titles: DataFrame, asking: bool, *more: str) -> DataFrame:
    """scope, seq, gram, n and columns `more`: what titles meet on. Two titles of two characters or more meet on bigrams; where one has a single
    character, on characters. A long title shows its characters to single ones only, and asks single ones only by them."""
    bare = F.replace(F.coalesce("title", F.lit("")), F.lit(" "), F.lit(""))
    chars = F.array_distinct(F.filter(F.split(bare, ""), lambda x: x != ""))
    tag = lambda name, items: F.transform(items, lambda g: F.concat(F.lit(name), g))
    rows = titles.select("scope", "seq", *more, F.length(bare).alias("long"), bigrams(F.col("title")).alias("two"), chars.alias("one"))
    single = F.concat(tag("s", F.col("one")), tag("l", F.col("one"))) if asking else tag("s", F.col("one"))
    both = F.array(F.struct(tag("b", F.col("two")).alias("grams"), F.size("two").alias("n")), F.struct(tag("s" if asking else "l", F.col("one")).alias("grams"), F.size("one").alias("n")))
    kinds = F.when(F.col("long") >= 2, both).otherwise(F.array(F.struct(single.alias("grams"), F.size("one").alias("n"))))
    return rows.select("scope", "seq", *more, F.explode(kinds).alias("k")).select("scope", "seq", *more, F.col("k.n").alias("n"), F.explode("k.grams").alias("gram"))


def best_overlaps(asking: DataFrame, among: DataFrame) -> DataFrame:
    """scope, seq, cand_seq, score: for each card of `asking` (scope, seq, title) the earlier card of `among` with the highest title
    overlap, the earliest of equals; none where no character is shared.

    Different titles are compared once. They meet by shared bigrams and pairs are counted by a shuffle on the pair. Of a title
    the earliest card of `among` stands for all; an asking title keeps those that are earlier than every better one, and each
    of its cards takes the best that is earlier than itself.
    """
    bare = lambda rows: rows.withColumn("title", F.replace(F.coalesce("title", F.lit("")), F.lit(" "), F.lit("")))
    asking = bare(asking)
    a = _title_keys(asking.groupBy("scope", "title").agg(F.max("seq").alias("seq")), True, "title").withColumnRenamed("n", "an")
    first = bare(among).groupBy("scope", "title").agg(F.min("seq").alias("seq"))
    b = _title_keys(first, False).select("scope", F.col("seq").alias("cand_seq"), F.col("n").alias("bn"), "gram")
    met = a.join(b, ["scope", "gram"]).where("cand_seq < seq").groupBy("scope", "title", "cand_seq").agg(F.count("*").alias("both"), F.first("an").alias("an"), F.first("bn").alias("bn"))
    met = met.withColumn("score", F.col("both") / (F.col("an") + F.col("bn") - F.col("both")))
    better = Window.partitionBy("scope", "title").orderBy(F.desc("score"), "cand_seq").rowsBetween(Window.unboundedPreceding, -1)
    useful = met.withColumn("least", F.min("cand_seq").over(better)).where("least IS NULL OR cand_seq < least")
    scored = asking.join(useful.select("scope", "title", "cand_seq", "score"), ["scope", "title"]).where("cand_seq < seq")
    best = scored.groupBy("scope", "seq").agg(F.min(F.struct(-F.col("score"), "cand_seq", "score")).alias("b"))
    return best.select("scope", "seq", "b.cand_seq", "b.score")


def vote(asked: Column, settings: Settings) -> Column:
    """(duplicate_of, channel) from the candidates that count (score, cand_seq, same), best first; null where none decides.

    With none at the normal threshold all must be judged the same; else a near-equal one judged the same decides, and
    otherwise the same weight must have over half of the voted weight.
    """
    s = settings
    hit = lambda c, how: F.struct(c["cand_seq"].alias("duplicate_of"), F.lit(how).alias("channel"))
    yes = lambda c: F.coalesce(c["same"], F.lit(False))
    normal = F.filter(asked, lambda c: c["score"] >= s.dedup_cosine)
    top = F.get(normal, F.lit(0))
    strong = (top["score"] >= s.dedup_strong) & top["same"].isNotNull()
    voted = F.filter(F.when(strong, F.slice(normal, F.lit(2), F.greatest(F.size(normal), F.lit(1)))).otherwise(normal), lambda c: c["same"].isNotNull())
    weight = lambda rows: F.aggregate(rows, F.lit(0.0), lambda total, c: total + c["score"])
    won = weight(F.filter(voted, yes)) > weight(voted) / 2
    first = F.get(F.filter(voted, yes), F.lit(0))
    return F.when(F.size(normal) == 0, F.when(F.forall(asked, yes) & (F.size(asked) > 0), hit(F.get(asked, F.lit(0)), "weak"))).when(strong & yes(top), hit(top, "strong")).when(won, hit(first, "vote"))


def _first_equal(pool: DataFrame, alive: DataFrame, key: str, how: str) -> DataFrame:
    """scope, seq, <how>: the first survivor of the card's equal group, where it is earlier than the card."""
    rows = pool.where(F.col(key).isNotNull()).select("scope", "seq", "fresh", key)
    first = rows.join(alive, ["scope", "seq"], "left_semi").groupBy("scope", key).agg(F.min("seq").alias(how))
    return rows.where("fresh").join(first, ["scope", key]).where(F.col(how) < F.col("seq")).select("scope", "seq", how)


def _prepared(cards: DataFrame, fresh: bool, image_sources: tuple[str, ...] | None) -> DataFrame:
    images = F.array_sort(F.array_distinct(F.filter(F.coalesce("image_urls", F.array().cast("array<string>")), lambda u: F.coalesce(F.trim(u), F.lit("")) != "")))
    allowed = F.col("source").isin(*image_sources) if image_sources is not None else F.lit(True)
    image = F.when((F.size(images) > 0) & allowed, F.concat_ws("\x00", F.col("source"), F.array_join(images, "\x00")))
    quote = F.col("source_quote")
    text = F.when((F.coalesce(quote, F.lit("")) != "") & ~is_placeholder_only(quote), digest(quote, 64))
    if "content_hash" in cards.columns:  # the stored hash of a text that may be gone
        text = F.coalesce(F.when(~is_placeholder_only(quote) & (F.col("content_hash") != ""), F.col("content_hash")), text)
    scope = F.col("scope") if "scope" in cards.columns else F.lit("")
    vector = [F.col("vec").cast("array<double>").alias("vec")] if "vec" in cards.columns else []
    has = F.coalesce(F.size("vec") > 0, F.lit(False)) if vector else F.col("has")
    return cards.select(scope.cast("string").alias("scope"), F.col("seq").cast("long").alias("seq"), "title", "source_quote", image.alias("image_key"), text.alias("text_key"), *vector, has.alias("has"), F.lit(fresh).alias("fresh"))


def decide(cards: DataFrame, judge: Judge, earlier: DataFrame | None = None, settings: Settings = Settings(), image_sources: tuple[str, ...] | None = None, near: DataFrame | None = None) -> DataFrame:
    """Every card with its decision: scope, seq, duplicate_of (null: it survives), how (image, hash, strong, vote, weak, overlap),
    channel (exact, cosine, overlap, cosine_no_candidate, none), cosine_ran, asked (verdicts that count).

    cards: seq, source, title, source_quote, image_urls, vec and, where there are several caches, scope. earlier: survivors of
    runs before, with smaller numbers; they stay. judge(scope, seq, cand_seq, title, quote, cand_title, cand_quote) adds `same`; each pair
    is judged once. image_sources: sources whose image sets count; all, where it is None. near: the pairs (scope, seq, cand_seq,
    score) where they are known; then a scope has one new card, and cards have `has` (whether there is a vector) in place of vec.
    """
    pool = _prepared(cards, True, image_sources)
    if earlier is not None:
        pool = pool.unionByName(_prepared(earlier, False, image_sources))
    if near is not None:
        return _alone(pool, near, judge, settings)
    pool = written(pool, "dedup-pool")
    low, listed = min(settings.dedup_fallback, settings.dedup_cosine), max(NEAREST, 4 * settings.dedup_top_k)
    near = written(cosine_pairs(pool, low, most=listed), "dedup-pairs")
    full = written(near.groupBy("scope", "seq").agg(F.count("*").alias("n")).where(F.col("n") == listed).select("scope", "seq"), "dedup-full")
    new = pool.where("fresh").select("scope", "seq")
    texts = pool.select("scope", "seq", "title", F.col("source_quote").alias("quote"))
    empty = near.select(*_PAIR).limit(0)
    known, best, alive_before, alive, seen = written(empty.withColumn("same", F.lit(True)), "verdicts"), None, None, pool.select("scope", "seq"), None
    while True:
        image, text = _first_equal(pool, alive, "image_key", "image"), _first_equal(pool, alive, "text_key", "hash")
        open_ = written(new.join(image, ["scope", "seq"], "left").join(text, ["scope", "seq"], "left"), "dedup-open")
        undecided = open_.where("image IS NULL AND hash IS NULL").select("scope", "seq")
        candidates = near.join(alive.withColumnRenamed("seq", "cand_seq"), ["scope", "cand_seq"], "left_semi").join(undecided, ["scope", "seq"], "left_semi")
        top = written(_ranked(candidates).where(F.col("rank") <= settings.dedup_top_k), "dedup-near")
        # Where a list is full and too few of it survive, survivors that it does not name may come next.
        short = written(full.join(undecided, ["scope", "seq"], "left_semi").join(top.where(F.col("rank") == settings.dedup_top_k), ["scope", "seq"], "left_anti"), "dedup-short")
        top = top.drop("rank")
        if not short.isEmpty():
            flagged = pool.select("scope", "seq", "vec").join(short.withColumn("fresh", F.lit(True)), ["scope", "seq"], "left").join(alive.withColumn("held", F.lit(True)), ["scope", "seq"], "left")
            more = cosine_pairs(flagged.fillna(False, ["fresh", "held"]).where("fresh OR held"), low, most=settings.dedup_top_k)
            top = top.join(short, ["scope", "seq"], "left_anti").select(*_PAIR, "score").unionByName(more)
        # Below the normal threshold a candidate counts only where none reaches it.
        high = F.max("score").over(Window.partitionBy("scope", "seq")) >= settings.dedup_cosine
        top = written(top.withColumn("high", high).where(~F.col("high") | (F.col("score") >= settings.dedup_cosine)).select(*_PAIR, "score"), "dedup-top")
        lonely = written(undecided.join(top.select("scope", "seq").distinct(), ["scope", "seq"], "left_anti"), "dedup-lonely")
        best = _overlaps(pool, lonely, alive, alive_before, best)
        over = best.where(F.col("score") >= settings.dedup_overlap).join(lonely, ["scope", "seq"], "left_semi")
        wanted = top.select(*_PAIR).union(over.select(*_PAIR)).join(known, _PAIR, "left_anti")
        pairs = wanted.join(texts, ["scope", "seq"]).join(texts.toDF("scope", "cand_seq", "cand_title", "cand_quote"), ["scope", "cand_seq"])
        known = written(known.unionByName(judge(pairs).select(*_PAIR, "same")), "verdicts")
        voted = top.join(known, _PAIR, "left").groupBy("scope", "seq").agg(F.array_sort(F.collect_list(F.struct(-F.col("score"), "cand_seq", "score", "same"))).alias("candidates"))
        ruled = voted.select("scope", "seq", vote(F.col("candidates"), settings).alias("v"), F.size("candidates").alias("n"))
        alone = over.join(known, _PAIR, "left").select("scope", "seq", F.when(F.coalesce("same", F.lit(False)), F.col("cand_seq")).alias("o"), F.lit(1).alias("one"))
        rows = open_.join(ruled, ["scope", "seq"], "left").join(alone, ["scope", "seq"], "left")
        exact = F.coalesce("image", "hash").isNotNull()
        how = F.when(F.col("image").isNotNull(), "image").when(F.col("hash").isNotNull(), "hash").when(F.col("n") > 0, F.col("v.channel")).when(F.col("o").isNotNull(), "overlap")
        channel = F.when(exact, "exact").when(F.col("n") > 0, "cosine").when(F.col("one") > 0, "overlap").otherwise("none")
        decided = rows.select("scope", "seq", F.coalesce("image", "hash", "v.duplicate_of", "o").alias("duplicate_of"), how.alias("how"), channel.alias("channel"), F.coalesce("n", "one", F.lit(0)).cast("int").alias("asked"))
        decided = written(decided, "decided")
        state = decided.where("duplicate_of IS NOT NULL").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("scope", "seq")).alias("h")).first()
        if state == seen:
            return _with_probe(decided, pool, alive)
        seen, gone = state, decided.where("duplicate_of IS NOT NULL").select("scope", "seq")
        alive_before, alive = alive, written(pool.select("scope", "seq").join(gone, ["scope", "seq"], "left_anti"), "alive")


def _alone(pool: DataFrame, near: DataFrame, judge: Judge, settings: Settings) -> DataFrame:
    """The decisions of scopes with one new card each. Its earlier cards stay, so one round is all there is: a scope becomes a row
    that holds its cards, and every channel is an expression over them. Only the judge's answers are joined. Each step of a job has
    its plan in the driver, so the few steps here are for the driver's memory as well."""
    card = F.struct("seq", "title", F.col("source_quote").alias("quote"), "image_key", "text_key", "has")
    pairs = near.select("scope", F.struct("seq", "cand_seq", "score").alias("pair"))
    rows = pool.select("scope", F.when(F.col("fresh"), card).alias("new"), F.when(~F.col("fresh"), card).alias("old")).unionByName(pairs, allowMissingColumns=True)
    held = rows.groupBy("scope").agg(F.max("new").alias("new"), F.collect_list("old").alias("old"), F.collect_list("pair").alias("near")).where("new IS NOT NULL")
    new = F.col("new")
    held = held.withColumn("old", F.filter("old", lambda c: c["seq"] < new["seq"]))
    equal = lambda key: F.array_min(F.transform(F.filter("old", lambda c: c[key] == new[key]), lambda c: c["seq"]))
    held = held.withColumns({"image": equal("image_key"), "hash": equal("text_key"), "seqs": F.transform("old", lambda c: c["seq"])})
    exact = F.coalesce("image", "hash").isNotNull()
    order = lambda c: F.struct((-c["score"]).alias("less"), c["cand_seq"].alias("cand_seq"), c["score"].alias("score"))
    mine = F.filter("near", lambda c: (c["seq"] == new["seq"]) & F.array_contains("seqs", c["cand_seq"]))
    nearest = F.slice(F.array_sort(F.transform(mine, order)), 1, settings.dedup_top_k)
    # Below the normal threshold a candidate counts only where none reaches it.
    high = F.coalesce(F.get("nearest", F.lit(0))["score"] >= settings.dedup_cosine, F.lit(False))
    held = held.withColumn("nearest", F.when(exact, F.slice(nearest, 1, 0)).otherwise(nearest)).withColumn("nearest", F.filter("nearest", lambda c: ~high | (c["score"] >= settings.dedup_cosine)))
    likeness = F.transform("old", lambda c: F.struct(c["seq"].alias("cand_seq"), title_overlap(new["title"], c["title"]).alias("score")))
    best = F.array_min(F.transform(F.filter(likeness, lambda c: c["score"] > 0), order))
    held = held.withColumn("best", F.when(~exact & (F.size("nearest") == 0), best)).withColumn("best", F.when(F.col("best.score") >= settings.dedup_overlap, F.col("best")))
    wanted = F.transform(F.when(F.col("best").isNotNull(), F.array("best")).otherwise(F.col("nearest")), lambda c: c["cand_seq"])
    probed = F.coalesce(new["has"], F.lit(False)) & F.exists("old", lambda c: F.coalesce(c["has"], F.lit(False)))
    shown = F.filter("old", lambda c: F.array_contains(wanted, c["seq"]))
    held = written(held.select("scope", new["seq"].alias("seq"), new["title"].alias("title"), new["quote"].alias("quote"), "image", "hash", "nearest", "best", probed.alias("probed"), shown.alias("shown")), "dedup-scopes")

    asked = held.select("scope", "seq", "title", "quote", F.explode("shown").alias("c")).select(*_PAIR[:2], F.col("c.seq").alias("cand_seq"), "title", "quote", F.col("c.title").alias("cand_title"), F.col("c.quote").alias("cand_quote"))
    told = judge(asked).groupBy("scope", "seq").agg(F.collect_list(F.struct("cand_seq", "same")).alias("told"))
    rows = held.drop("shown", "title", "quote").join(told, ["scope", "seq"], "left")
    said = lambda seq: F.get(F.filter("told", lambda t: t["cand_seq"] == seq), F.lit(0))["same"]
    voted = F.transform("nearest", lambda c: F.struct(c["cand_seq"].alias("cand_seq"), c["score"].alias("score"), said(c["cand_seq"]).alias("same")))
    rows = rows.withColumn("nearest", voted).withColumn("v", vote(F.col("nearest"), settings)).withColumn("o", F.when(said(F.col("best.cand_seq")), F.col("best.cand_seq")))
    n = F.size("nearest")
    how = F.when(F.col("image").isNotNull(), "image").when(F.col("hash").isNotNull(), "hash").when(n > 0, F.col("v.channel")).when(F.col("o").isNotNull(), "overlap")
    ran = ~exact & F.col("probed")
    channel = F.when(exact, "exact").when(n > 0, "cosine").when(F.col("best").isNotNull(), "overlap").when(ran, "cosine_no_candidate").otherwise("none")
    count = F.when(n > 0, n).when(F.col("best").isNotNull(), 1).otherwise(0)
    decided = rows.select("scope", "seq", F.coalesce("image", "hash", "v.duplicate_of", "o").alias("duplicate_of"), how.alias("how"), channel.alias("channel"), ran.alias("cosine_ran"), count.cast("int").alias("asked"))
    return written(decided, "decided")


def _with_probe(decided: DataFrame, pool: DataFrame, alive: DataFrame) -> DataFrame:
    """The decisions with `cosine_ran`: the card has a vector and an earlier survivor has one too."""
    vectors = pool.where("has").select("scope", "seq")
    first = vectors.join(alive, ["scope", "seq"], "left_semi").groupBy("scope").agg(F.min("seq").alias("first_vector"))
    rows = decided.join(vectors.withColumn("has", F.lit(True)), ["scope", "seq"], "left").join(_by_scope(first), "scope", "left")
    ran = (F.col("channel") != "exact") & F.coalesce("has", F.lit(False)) & F.coalesce(F.col("first_vector") < F.col("seq"), F.lit(False))
    channel = F.when(ran & (F.col("channel") == "none"), "cosine_no_candidate").otherwise(F.col("channel"))
    return rows.select("scope", "seq", "duplicate_of", "how", channel.alias("channel"), ran.alias("cosine_ran"), "asked")


def _overlaps(pool: DataFrame, lonely: DataFrame, alive: DataFrame, alive_before: DataFrame | None, before: DataFrame | None) -> DataFrame:
    """The best overlap of each lonely card among the survivors. After the first round only what changed is compared again:
    cards whose best is gone or that are newly lonely with all survivors, the others with those that came back."""
    titles = pool.select("scope", "seq", "title")
    among = titles.join(alive, ["scope", "seq"], "left_semi")
    asking = titles.join(lonely, ["scope", "seq"], "left_semi")
    if before is None:
        return written(best_overlaps(asking, among), "overlaps")
    kept = written(before.join(alive.withColumnRenamed("seq", "cand_seq"), ["scope", "cand_seq"], "left_semi").join(lonely, ["scope", "seq"], "left_semi"), "kept")
    mine = kept.select("scope", "seq")
    back = written(among.join(alive_before, ["scope", "seq"], "left_anti"), "back")
    every = kept.select(*_PAIR, "score").unionByName(best_overlaps(asking.join(mine, ["scope", "seq"], "left_anti"), among))
    if not back.isEmpty():
        every = every.unionByName(best_overlaps(asking.join(mine, ["scope", "seq"], "left_semi"), back))
    best = every.groupBy("scope", "seq").agg(F.min(F.struct(-F.col("score"), "cand_seq", "score")).alias("b"))
    return written(best.select("scope", "seq", "b.cand_seq", "b.score"), "overlaps")


def greedy_dedup(cards: DataFrame, judge: Judge, earlier: DataFrame | None = None, settings: Settings = Settings(), image_sources: tuple[str, ...] | None = None) -> DataFrame:
    """(seq, duplicate_of, channel) of the duplicates among the cards of one cache; see `decide`."""
    found = decide(cards, judge, earlier, settings, image_sources)
    return found.where("duplicate_of IS NOT NULL").select("seq", "duplicate_of", F.col("how").alias("channel"))


def unjudged(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (title, quote, item_id, item_version) that no stored negative verdict (qkey, item_id, item_version) covers."""
    keyed = pairs.withColumn("qkey", judge_key(F.col("title"), F.col("quote")))
    return keyed.join(known.where("NOT same").select("qkey", "item_id", "item_version"), ["qkey", "item_id", "item_version"], "left_anti")


def recent_negatives(log: DataFrame, most: int) -> DataFrame:
    """The newest `most` negative verdicts of each item, as a bounded store."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("ts"), "qkey"))
    return log.where("NOT same").withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
