"""Mixing sources to target weights with a low-discrepancy source schedule.

All words are divided into about a million slots. Slot j maps the golden-ratio point frac(j * phi) through the
cumulative weights of the sources, so every stretch of the schedule has each source near its share. Slots are ranked
within their source, and slot r of a source takes block r of that source's line of shuffled documents, cut into blocks
of equal words; after the last block the line starts again, three times at most.

Ranks and running sums are taken in two levels (buckets, then totals of buckets), so a source with a third of all rows
is spread over many tasks. The only single-task windows are over the table of sources, a row of numbers each: they suit
up to some millions of sources (a collection, a host), not a source per document.

Defined results: null text has size 0 and is never taken; null source is a source of its own, last in order; repeated
rows and identifiers are separate documents (rows equal in identifier, source and text are one line entry of
`mixed_documents` and are taken equally often); an empty table gives an empty result; extra columns are ignored by
`mix_schedule` and kept by `mixed_documents`. Reruns over the same rows agree: the shuffle is a seeded hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, materialise, prefix_ranks
from larkspur.llm.exact_dedup import normalised

WEIGHTS = (1, 2, 3)
REPEATS = 3
SLOTS = 1 << 20
SEED = 17
#: floor(2^32 / phi): the golden-ratio step of the point sequence.
_GOLDEN = 2654435769
_CELLS = 1024
#: Rows that a rank within one bucket should hold.
RANK_ROWS = 500


def word_count(text: str) -> Column:
    """The number of runs of characters that are not ASCII white space; null counts as 0."""
    flat = F.trim(normalised(text))
    return F.when(flat == "", F.lit(0)).otherwise(F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_no, source_size, target for (source, size): shares by weight, held at `repeats` times a source's
    size, the excess reshared by weight.

    The reshared result is a water level: with the sources in order of cap per weight, those whose cap lies under the
    level of the rest keep their cap, and the others get the level times their weight.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", number).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "source_no")
    rows = rows.withColumns({
        "all_words": F.sum("source_size").over(Window.partitionBy()).cast("double"),
        "caps_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weights_from": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("level", (F.col("all_words") - F.col("caps_before")) / F.col("weights_from"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(math.inf)))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def _schedule(sources: DataFrame, all_words: int, repeats: int, slots: int) -> DataFrame:
    """source_no, block, times: how often the schedule takes each block of each source."""
    block = max(1, all_words // slots)
    live = sources.where("source_size > 0")
    count = F.greatest(F.lit(1), F.round(F.col("source_size") / block)).cast("long")
    live = live.withColumn("block_words", F.ceil(F.col("source_size") / count).cast("long"))
    live = live.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    live = live.withColumn("share", F.col("target") / F.col("block_words"))
    line = Window.orderBy("source_no")
    live = live.withColumns({"all_slots": F.sum("share").over(Window.partitionBy()), "upto": F.sum("share").over(line), "last": F.lead("source_no").over(line).isNull()})
    lo, hi = (F.col("upto") - F.col("share")) / F.col("all_slots"), F.when(F.col("last"), 1.0).otherwise(F.col("upto") / F.col("all_slots"))
    spans = live.select("source_no", "blocks", lo.alias("lo"), hi.alias("hi"))
    # A cell of the unit interval with each source that reaches into it: a join by cell replaces a range join.
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS).cast("long"), F.least(F.lit(_CELLS - 1), F.floor(F.col("hi") * _CELLS)).cast("long"))))
    n = live.agg(F.round(F.sum("share")).cast("long").alias("n")).first()["n"] or 0
    point = (F.col("id") * F.lit(_GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
    points = live.sparkSession.range(1, n + 1).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * _CELLS).cast("long"))
    dealt = points.join(cells, "cell").where("point >= lo AND point < hi").select("id", "source_no", "blocks")
    ranked = prefix_ranks(dealt, ["source_no"], ["id"], F.floor(F.col("id") / RANK_ROWS), "rank")
    return ranked.where(F.col("rank") < repeats * F.col("blocks")).groupBy("source_no", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def _taken(sized: DataFrame, weights: tuple[int, ...], repeats: int, slots: int, seed: int) -> DataFrame:
    """row_id, source_size, target, taken for the table (row_id, doc_id, text_key, source, size)."""
    sources = materialise(source_targets(sized, weights, repeats), "sources")
    totals = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    n_rows, words = totals["n"], totals["words"]
    times = _schedule(sources, words, repeats, slots)
    plan = sources.select(F.col("source").alias("source__k"), "source_no", "source_size", "target")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("source__k")), "left").drop("source__k", "source")
    bits = max(0, math.ceil(math.log2(max(1, n_rows / RANK_ROWS))))
    key = F.xxhash64(F.col("doc_id"), F.col("text_key"), F.lit(seed))  # documents without an identifier are spread by their texts
    shuffled = rows.withColumn("shuffle_key", key)
    bucket = F.shiftright("shuffle_key", 64 - bits) if bits else F.lit(0)
    lined = prefix_ranks(shuffled, ["source_no"], ["shuffle_key", "doc_id", "size", "row_id"], bucket, "begin", weight="size")
    count = F.greatest(F.lit(1), F.round(F.col("source_size") / max(1, words // slots))).cast("long")
    block_words = F.ceil(F.col("source_size") / count).cast("long")
    cut = lined.where("size > 0").withColumn("block_words", block_words)
    first, last = F.floor(F.col("begin") / F.col("block_words")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("block_words"))
    parts = cut.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest(F.col("begin"), F.col("block") * F.col("block_words"))
    got = parts.join(times, ["source_no", "block"]).groupBy("row_id").agg(F.sum(overlap * F.col("times")).alias("taken"))
    return rows.join(got, "row_id", "left").select("row_id", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    sized = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    return _taken(materialise(sized, "sizes"), weights, repeats, slots, seed).drop("row_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as rows of docs: each row as many times as the schedule takes its words, rounded to whole documents.

    Rows without words stay once: they cost nothing.
    """
    entry = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source")]
    lines = docs.groupBy(*entry).agg(F.count("*").alias("equal"), F.first(word_count(text_col)).alias("each"))
    lines = materialise(lines.withColumns({"row_id": F.monotonically_increasing_id(), "size": F.col("equal") * F.col("each")}), "sizes")
    taken = _taken(lines.select("row_id", "doc_id", "text_key", "source", "size"), weights, repeats, slots, seed).select("row_id", "taken")
    # Equal rows share what their line entry takes.
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    names = {c: free_name(docs, f"{c}_k") for c in ("doc_id", "text_key", "source", "copies")}
    plan = lines.join(taken, "row_id").withColumn("copies", copies).where("copies > 0").select(*[F.col(c).alias(n) for c, n in names.items()])
    same = docs[id_col].eqNullSafe(plan[names["doc_id"]]) & docs[source_col].eqNullSafe(plan[names["source"]]) & (F.xxhash64(docs[text_col]) == plan[names["text_key"]])
    joined = docs.join(plan, same)
    return joined.withColumn(names["copies"], F.explode(F.array_repeat(F.lit(0), F.col(names["copies"])))).select(*docs.columns)
