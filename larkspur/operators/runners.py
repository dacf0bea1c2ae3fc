"""Benchmark runners: cases as a frame through the features as they are, each case with a cache of its own.

All cases of a feature go through one pass. What a case may see is its scope: cards of other cases are never candidates, so
the pass equals a run case by case. Every runner gives a row a case, an error instead of a failed job, and for
near-duplicates what decided: the probe columns channel, cosine_ran and skipped (no judge was asked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import embedding_text, title_similarity
from larkspur.functions.jsonx import parse_title
from larkspur.operators import dedup, metrics
from larkspur.operators.classify import classify_messages
from larkspur.operators.neighbours import pair_cosines
from larkspur.ports.ai import ProviderFactory, ask, embed, judge_pairs
from larkspur.schemas import Settings
from larkspur.scratch import written

_CARD = ["title", "source_quote", "source", "image_urls"]
#: Where a case's query stands after its cards.
_LAST = 1 << 40


def _title_judge(factory: ProviderFactory) -> dedup.Judge:
    text = lambda t, q: F.concat_ws("\n", t, q)
    return lambda pairs: judge_pairs(pairs, text(F.col("title"), F.col("quote")), text(F.col("cand_title"), F.col("cand_quote")), factory)


def _nearest(rows: DataFrame, minimum: float) -> DataFrame:
    """rows (scope, seq, vec and more; a case's cards one after the other, its query last) with `has` (whether there is a vector)
    and, at the query, `near`: the cards (cand_seq, score) whose cosine is at least `minimum`. The vectors end here, where they
    are made; they are neither written nor shuffled."""
    more = [f.name for f in rows.schema if f.name not in ("vec",)]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            near, has = [], []
            for seq, vec in zip(batch["seq"].tolist(), batch["vec"], strict=True):
                size = np.linalg.norm(vec) if vec is not None and len(vec) else 0.0
                has.append(vec is not None and len(vec) > 0)
                unit = np.asarray(vec) / size if size else None
                if seq < _LAST:
                    near.append([])
                    held += [(seq, unit)] if size else []
                    continue
                scored = [{"cand_seq": s, "score": float(u @ unit)} for s, u in held if len(u) == len(unit)] if size else []
                near.append([c for c in scored if c["score"] >= minimum])
                held = []
            yield batch[more].assign(has=has, near=near)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in more)
    return rows.mapInPandas(meet, f"{fields}, has boolean, near array<struct<cand_seq: long, score: double>>")


def run_dedup(cases: DataFrame, factory: ProviderFactory, settings: Settings = Settings(), image_sources: tuple[str, ...] | None = None, judge: dedup.Judge | None = None) -> DataFrame:
    """case_id, expected, predicted, channel, cosine_ran, skipped, error of cases (case_id, items: array of cards, query: a card,
    same): the query against the case's cards, as a new card would be decided. Cards: title, source_quote, source, image_urls."""
    items = F.transform("items", lambda c, i: F.struct(i.cast("long").alias("seq"), *[c[n].alias(n) for n in _CARD]))
    query = F.array(F.struct(F.lit(_LAST).cast("long").alias("seq"), *[F.col(f"query.{n}").alias(n) for n in _CARD]))
    rows = cases.select("case_id", F.col("case_id").cast("string").alias("scope"), F.col("same").alias("expected"), F.explode(F.concat(F.coalesce(items, F.slice(query, 1, 0)), query)).alias("c")).select("case_id", "scope", "expected", "c.*")
    vectored = embed(rows, embedding_text(F.col("title"), F.col("source_quote")), factory)
    cards = written(_nearest(vectored, min(settings.dedup_fallback, settings.dedup_cosine)), "case-cards")
    near = cards.select("scope", "seq", F.explode("near").alias("n")).select("scope", "seq", "n.cand_seq", "n.score")
    found = dedup.decide(cards.where(F.col("seq") == _LAST), judge or _title_judge(factory), cards.where(F.col("seq") < _LAST), settings, image_sources, near)
    rows = cards.where(F.col("seq") == _LAST).select("case_id", "scope", "expected").join(found, "scope")  # the cases are read once
    return rows.select("case_id", "expected", F.col("duplicate_of").isNotNull().alias("predicted"), "channel", "cosine_ran", (F.col("asked") == 0).alias("skipped"), F.lit(None).cast("string").alias("error"))


def run_merge(cases: DataFrame, factory: ProviderFactory, settings: Settings = Settings()) -> DataFrame:
    """case_id, expected, predicted, skipped, error of cases (case_id, head, tail: structs of title and content, merge). With a
    prefilter (merge_prefilter of 0 or more) pairs whose vectors are less alike are not merged and not judged; a pair without
    vectors is judged. A judge without an answer is an error."""
    sides = cases.select("case_id", "head", "tail", F.col("merge").alias("expected"))
    low = F.lit(False)
    if settings.merge_prefilter >= 0:
        texts = sides.select(F.col("case_id").cast("string").alias("case"), F.explode(F.array(*[F.struct(F.lit(c).alias("side"), embedding_text(F.col(f"{c}.title"), F.col(f"{c}.content")).alias("text")) for c in ("head", "tail")])).alias("s")).select(F.concat("case", F.lit("/"), "s.side").alias("id"), "s.text")
        vectors = embed(texts, F.col("text"), factory).select("id", "vec")
        pairs = sides.select(F.col("case_id"), *[F.concat(F.col("case_id").cast("string"), F.lit(f"/{c}")).alias(n) for n, c in (("a", "head"), ("b", "tail"))])
        sides = sides.join(pair_cosines(pairs, vectors).select("case_id", "cosine"), "case_id")
        low = F.coalesce(F.col("cosine") < settings.merge_prefilter, F.lit(False))
    sides = sides.withColumn("skipped", low)
    text = lambda c: F.concat_ws("\n", f"{c}.title", f"{c}.content")
    judged = judge_pairs(sides.where("NOT skipped").select("case_id", text("head").alias("h"), text("tail").alias("t")), F.col("h"), F.col("t"), factory).select("case_id", F.col("same").alias("got"))
    rows = sides.join(judged, "case_id", "left")
    error = F.when(~F.col("skipped") & F.col("got").isNull(), "the judge gave no verdict")
    return rows.select("case_id", "expected", F.coalesce("got", F.lit(False)).alias("predicted"), "skipped", error.alias("error"))


def run_classify(cases: DataFrame, factory: ProviderFactory, categories: list[str]) -> DataFrame:
    """case_id, seq, expected, got, status, hit of cases (case_id, messages: array of content and expected; null: to be left out)."""
    rows = cases.select("case_id", F.posexplode("messages").alias("seq", "m")).select("case_id", F.col("seq").cast("long").alias("seq"), "m.content", "m.expected")
    got = classify_messages(rows.withColumnRenamed("case_id", "batch_id"), factory, categories).withColumnRenamed("batch_id", "case_id")
    hit = F.col("category").eqNullSafe(F.col("expected")) & (F.col("status") != "failed")
    return got.select("case_id", "seq", "expected", F.col("category").alias("got"), "status", hit.alias("hit"))


def run_title(cases: DataFrame, factory: ProviderFactory) -> DataFrame:
    """case_id, title, similarity, keywords, fallback of cases (case_id, old_title, content, expected_title, keywords): the model's title,
    or the old one where it gives none."""
    told = ask(cases, F.concat_ws("\n", F.col("content")), factory, "answer")
    title = parse_title(F.col("answer"))
    rows = told.withColumn("made", title).withColumn("title", F.coalesce("made", "old_title"))
    return rows.select("case_id", "title", title_similarity(F.col("title"), F.col("expected_title")).alias("similarity"), "keywords", F.col("made").isNull().alias("fallback"))


def dedup_report(evals: DataFrame) -> DataFrame:
    """One row: the confusion metrics of the cases without an error and what decided them."""
    valid = evals.where("error IS NULL")
    return metrics.binary_metrics(valid, "expected", "predicted").crossJoin(F.broadcast(metrics.channel_distribution(evals)))  # a row each


def classify_report(evals: DataFrame) -> DataFrame:
    """One row: messages, hits, their rate, false positives and failed ones."""
    return evals.agg(
        F.count("*").alias("messages"), F.count_if("hit").alias("hits"), metrics.safe_ratio(F.count_if("hit"), F.count("*")).alias("hit_rate"),
        F.count_if(F.col("expected").isNull() & F.col("got").isNotNull()).alias("false_positives"), F.count_if(F.col("status") == "failed").alias("failed"),
    )
