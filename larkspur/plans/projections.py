"""Queries of projections and stores that had tests only: cards of messages, chunk upserts, vectors by model, pruned cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import filters, state
from larkspur.plans.frames import table_of
from larkspur.plans.registry import query
from larkspur.sources import files


@query("card_projection", """SELECT substring(sha256(concat_ws(chr(0), 'app', CAST(doc_id AS VARCHAR))), 1, 32) AS id, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 50) ELSE concat('Doc ', doc_id) END AS title,
  substring(sha256(text), 1, 16) AS content_hash, lang AS category, CAST(doc_id AS VARCHAR) AS source_msg_id, 0 AS is_verified FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""")
def card_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as classified messages, each third with a blank title."""
    none = F.lit(None).cast("string")
    given = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("Doc "), F.col("doc_id")))
    docs = table_of(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = docs.select(F.lit("app").alias("source"), F.col("doc_id").cast("string").alias("msg_id"), F.col("text").alias("content"), F.col("lang").alias("category"), given.alias("title"), F.lit("s").alias("session_id"), F.col("source").alias("group_name"), (F.col("doc_id") * 60).alias("timestamp"),
                       *[none.alias(c) for c in ("key_info", "sender_name", "subject", "image_urls", "article_url", "start", "end", "extra_times")])
    return filters.card_of_message(rows).select("id", "title", "content_hash", "category", "source_msg_id", "is_verified")


@query("chunk_upsert", """WITH t AS (SELECT conv_id * 1000 + turn AS msg_id, turn, text FROM conversations WHERE turn % 3 <> 0 OR turn % 2 = 0)
  SELECT msg_id, CASE WHEN turn % 2 = 0 THEN concat('new ', text) ELSE text END AS content, CASE WHEN turn % 2 = 0 AND turn % 4 <> 0 THEN 'n' WHEN turn % 3 <> 0 THEN concat('i', turn % 5) ELSE '' END AS item_id FROM t""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed turns that meet rewritten ones, half of these without a card link."""
    c = table_of(spark, sf_dir, "conversations").withColumns({"source": F.lit("app"), "msg_id": F.col("conv_id") * 1000 + F.col("turn"), "msg_time": F.col("turn").cast("long")})
    columns = ["source", "msg_id", F.col("conv_id").alias("session_id"), F.lit("g").alias("group_name"), F.col("role").alias("sender_name"), "msg_time"]
    table = c.where("turn % 3 <> 0").select(*columns, F.col("text").alias("content"), F.concat(F.lit("i"), F.col("turn") % 5).alias("item_id"))
    rows = c.where("turn % 2 = 0").select(*columns, F.concat(F.lit("new "), F.col("text")).alias("content"), F.when(F.col("turn") % 4 == 0, "").otherwise("n").alias("item_id"))
    return state.upsert_chunks(table, rows).select("msg_id", "content", "item_id")


@query("vectors_by_model", """SELECT vec_id % 97 AS item_id, max(vec_id) AS newest, CAST(arg_max(embedding[1], vec_id) AS DOUBLE) AS head FROM embeddings WHERE label % 2 = 1 AND vec_id IS NOT NULL GROUP BY 1""")
def vectors_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest vector of each card for one of two models."""
    store = table_of(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").select((F.col("vec_id") % 97).alias("item_id"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), "embedding", F.col("vec_id").alias("created_at"))
    return files.load_vectors(store, "m1").select("item_id", F.col("created_at").alias("newest"), F.element_at("embedding", 1).cast("double").alias("head"))


@query("pruned_cases", "WITH edge AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents), once AS (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) = 1) SELECT CAST(d.doc_id AS VARCHAR) AS id FROM documents d, edge WHERE NOT (d.doc_id IN (lo, hi) AND d.doc_id IN (SELECT doc_id FROM once))")
def pruned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a document without the first and the last one."""
    docs = table_of(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    ends = docs.where(F.col("doc_id").isin([x for x in (lo, hi) if x is not None])).groupBy("doc_id").count().where("count = 1").collect()  # two rows at most
    return state.prune_cases(docs.select(F.col("doc_id").cast("string").alias("id")), [str(r["doc_id"]) for r in ends])
