"""Hybrid retrieval: keywords and vectors, fused by reciprocal ranks, with a gate that refuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import contains_folded
from larkspur.operators.lists import evidence
from larkspur.operators.trigram_index import B, FIELDS, K1, TrigramIndex
from larkspur.schemas import Settings
from larkspur.scratch import written


def tokens(query: str) -> list[str]:
    return query.split()


def substring_search(chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """Chunks whose content has every word of the query, newest first."""
    hit = F.lit(bool(tokens(query)))
    for t in tokens(query):
        hit = hit & contains_folded(F.col("content"), t)
    return chunks.where(hit).orderBy(F.desc("msg_time"), "msg_id").limit(limit)


def phrase_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """source, msg_id and, for each term, how often it occurs in the searched fields (overlapping places count), and the fields'
    trigrams in all."""
    text = F.lower(F.concat_ws("\x01", *[F.coalesce(F.col(f), F.lit("")) for f in FIELDS]))
    counts = [F.regexp_count(F.col("text__"), F.concat(F.lit("(?=\\Q"), F.lower(F.lit(t)), F.lit("\\E)"))).alias(f"tf_{i}") for i, t in enumerate(terms)]
    length = sum((F.greatest(F.length(F.coalesce(F.col(f), F.lit(""))) - 2, F.lit(0)) for f in FIELDS), F.lit(0))
    return chunks.withColumn("text__", text).select("source", "msg_id", *counts, length.alias("grams"))


def bm25_search(chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """source, msg_id, score, rank of the chunks with every word of the query (three characters at least) as a phrase, best BM25
    first: one scan of all texts, for chunks without an index. `trigram_index` answers the same from postings.

    A phrase of trigrams occurs where the word occurs. The counts of a chunk are written as numbers and read twice: for
    document frequency, number and mean length, and for the scores.
    """
    terms = tokens(query)
    rows = written(phrase_counts(chunks, terms), "phrase-counts")
    stats = rows.agg(F.count("*").alias("docs"), F.avg("grams").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    score, every = F.lit(0.0), F.lit(bool(terms))
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.greatest(F.log((F.col("docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("grams") / F.col("mean")))
        every = every & (tf > 0)
    best = joined.where(every).select("source", "msg_id", score.alias("score")).orderBy(F.desc("score"), "source", "msg_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source", "msg_id")))


def keyword_search(chunks: DataFrame, query: str, limit: int = 12, index: TrigramIndex | None = None) -> DataFrame:
    """source, msg_id, rank: by BM25 where every word has three characters, from the index where there is one, else by
    substrings, newest first."""
    terms = tokens(query)
    if terms and min(map(len, terms)) >= 3:
        found = index.search([query], limit) if index else bm25_search(chunks, query, limit)
        return found.select("source", "msg_id", "rank")
    rank = F.row_number().over(Window.orderBy(F.desc("msg_time"), F.asc("msg_id")))
    return substring_search(chunks, query, limit).withColumn("rank", rank).select("source", "msg_id", "rank")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (question, source, msg_id, rank, cos) and (question, source, msg_id, rank)."""
    key = ["question", "source", "msg_id"]
    v = vector_hits.select(*key, F.col("rank").alias("v_rank"), "cos")
    w = keyword_hits.select(*key, F.col("rank").alias("k_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return v.join(w, key, "full_outer").select(*key, F.coalesce("cos", F.lit(0.0)).alias("cos"), (part("v_rank") + part("k_rank")).alias("rrf"), F.col("k_rank").isNotNull().alias("has_keyword"))


def refusal_gate(fused: DataFrame, minimum: float = 0.25) -> DataFrame:
    """Hits of questions that may be answered: some keyword hit, or the top fused hit is near enough."""
    w = Window.partitionBy("question")
    top = F.max_by("cos", F.struct("rrf", "msg_time")).over(w)
    return fused.withColumn("go__", F.bool_or("has_keyword").over(w) | (top >= minimum)).where("go__").drop("go__")


def retrieve(vector_hits: DataFrame, keyword_hits: DataFrame, chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Numbered evidence for each question, or no row where the answer must be refused."""
    fused = fuse(vector_hits, keyword_hits, settings.fusion_k).join(chunks, ["source", "msg_id"])
    return evidence(refusal_gate(fused, settings.rag_refusal), settings.rag_evidence)


def answer_status(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """question, status: refused, retrieve_error, answer_error, cancelled or answered."""
    n = hits.groupBy("question").agg(F.count("*").alias("n"))
    rows = questions.join(n, "question", "left").join(answers, "question", "left")
    status = F.when(F.col("retrieve_failed"), "retrieve_error").when(F.col("cancelled"), "cancelled").when(F.col("n").isNull(), "refused").when(F.col("answer").isNull(), "answer_error").otherwise("answered")
    return rows.select("question", status.alias("status"))
