"""Queries over stores that a run builds, updates and reads: the trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.trigram_index import TrigramIndex
from larkspur.operators.vector_cache import VectorCache
from larkspur.plans.frames import table_of
from larkspur.plans.registry import query
from larkspur.scratch import scratch_path
from larkspur.sources.metrics_sink import MetricsSink


def bm25_sql(questions: list[str], limit: int, chunks: str, source: str = "'app'") -> str:
    """BM25 of each question over `chunks` (msg_id, text, group_name), phrases counted in whole texts; terms must not overlap
    with themselves."""
    asked = [(q, i, t.lower(), len(q.split())) for q in questions for i, t in enumerate(q.split())]
    values = ", ".join(f"('{q}', {i}, '{t}', {n})" for q, i, t, n in asked)
    return f"""WITH term(question, i, term, terms) AS (VALUES {values}),
  c AS (SELECT {source} AS source, msg_id, lower(coalesce(text, '')) || chr(1) || lower(coalesce(group_name, '')) AS line, greatest(length(coalesce(text, '')) - 2, 0) + greatest(length(coalesce(group_name, '')) - 2, 0) AS grams FROM ({chunks})),
  stats AS (SELECT count(*) AS docs, avg(grams) AS mean FROM c),
  words AS (SELECT DISTINCT term FROM term),
  n AS (SELECT source, msg_id, grams, term, CAST((length(line) - length(replace(line, term, ''))) / length(term) AS BIGINT) AS tf FROM c, words WHERE contains(line, term)),
  df AS (SELECT term, count(*) AS df FROM n GROUP BY 1),
  s AS (SELECT question, source, msg_id, any_value(terms) AS terms, count(*) AS met, sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * grams / mean))) AS score FROM term JOIN n USING (term) JOIN df USING (term), stats GROUP BY question, source, msg_id),
  r AS (SELECT question, source, msg_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, source, msg_id) AS INT) AS rank FROM s WHERE met = terms)
  SELECT question, source, msg_id, score, rank FROM r WHERE rank <= {limit}"""


QUESTIONS = ["tion ereres", "password", "license with", "ing the", "hand", "src1 ent"]


@query("trigram_search", bm25_sql(QUESTIONS, 40, "SELECT 'doc' AS kind, doc_id AS msg_id, text, source AS group_name FROM documents UNION ALL SELECT 'bench', item_id, text, NULL FROM benchmark", "kind"))
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as two segments of an index, then several questions at once from its postings."""
    chunk = lambda kind, key, group: [F.lit(kind).alias("source"), F.col(key).alias("msg_id"), F.col("text").alias("content"), F.lit("").alias("sender_name"), group.alias("group_name"), F.lit(0).cast("long").alias("msg_time")]
    index = TrigramIndex(spark, scratch_path(spark, "index"))
    index.append(table_of(spark, sf_dir, "documents").select(*chunk("doc", "doc_id", F.col("source"))))
    index.append(table_of(spark, sf_dir, "benchmark").select(*chunk("bench", "item_id", F.lit(None).cast("string"))))
    return index.search(QUESTIONS, 40).withColumn("score", F.round("score", 6))


@query("vector_cache", "SELECT vec_id AS msg_id, CASE WHEN vec_id % 2 = 1 AND vec_id % 11 = 0 THEN 'dimension' ELSE 'kept' END AS state, len(embedding) - CASE WHEN vec_id % 2 = 1 AND vec_id % 11 = 0 THEN len(embedding) ELSE 0 END AS size FROM embeddings WHERE vec_id IS NOT NULL")
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after two refreshes, the second of which brings the odd rows, some of a dimension of their own."""
    v = table_of(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL")
    odd = F.col("vec_id") % 2 == 1
    cut = F.when(odd & (F.col("vec_id") % 11 == 0), F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    store = v.select(F.lit("app").alias("source"), F.col("vec_id").alias("msg_id"), F.lit("m").alias("model"), F.to_json(cut).alias("embedding"), F.when(odd, "2").otherwise("1").alias("created_at"))
    cache = VectorCache(spark, scratch_path(spark, "vector-cache"))
    cache.refresh(store.where("created_at = '1'"), "m")
    done = cache.refresh(store, "m")
    kept = cache.vectors().select("msg_id", F.lit("kept").alias("state"), F.size("vec").cast("long").alias("size"))
    return kept.unionByName(done.bad.select("msg_id", F.col("why").alias("state"), F.lit(0).cast("long").alias("size")))


@query("decision_log", """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, value FROM events WHERE ts IS NOT NULL) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS decisions, max(event_id) AS newest FROM e WHERE day >= (SELECT max(day) FROM e) - INTERVAL 14 DAY GROUP BY 1""")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions through the metrics sink, odd and even ones as a batch each, the second twice; the days within retention."""
    events = table_of(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", F.col("value").alias("cosine"), "ts")
    sink = MetricsSink(spark, scratch_path(spark, "metrics"), decision_days=14)
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    if last is None:
        return events.select(F.lit("").alias("day"), F.lit(0).cast("long").alias("decisions"), F.col("event_id").alias("newest"))
    for batch in (0, 1, 1):
        sink.flush(batch, last, decisions=events.where(F.pmod("event_id", F.lit(2)) == batch))
    sink.prune(last.date())
    return sink.log("decisions").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("decisions"), F.max("event_id").alias("newest"))
