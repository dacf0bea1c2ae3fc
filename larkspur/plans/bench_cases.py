"""Queries that take benchmark cases through the features to their metrics, with the stub providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import cases, metrics, runners
from larkspur.operators.classify import classify_messages
from larkspur.plans.frames import ctes, frame, table_of
from larkspur.plans.registry import query
from larkspur.ports.ai import StubClassifier, StubProvider

NAMES = ["notice", "lecture", "sport", "market"]
_SIZE = 16
_LENGTH = r"length(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_RULED = f"""SELECT conv_id, turn, {_LENGTH} AS n FROM conversations"""
_LIST = "['" + "','".join(NAMES) + "']"
_STATUS = "CASE WHEN n % 7 = 0 THEN 'exclude' WHEN n % 13 = 0 THEN 'failed' ELSE 'include' END"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of one conversation and at most _SIZE turn numbers."""
    batch = F.concat_ws("/", F.col("conv_id"), F.floor(F.col("turn") / _SIZE))
    return table_of(spark, sf_dir, "conversations").select("conv_id", "turn", batch.alias("batch_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))


@query("classify_answers", f"""WITH r AS ({_RULED}), s AS (SELECT *, {_STATUS} AS status FROM r)
  SELECT conv_id, turn, status, CASE WHEN status = 'failed' THEN 'unknown category' END AS reason, CASE WHEN status = 'include' THEN {_LIST}[n % {len(NAMES)} + 1] END AS category, CASE WHEN status = 'include' THEN concat('k', n % 5) ELSE '' END AS key_info, status = 'include' AND n % 3 = 0 AS time FROM s""")
def classify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns through classification: answers with gaps, unknown names, broken JSON and cut ends, each message with its outcome."""
    got = classify_messages(_batches(spark, sf_dir), StubClassifier, NAMES)
    return got.select("conv_id", "turn", "status", "reason", "category", "key_info", "time")


@query("bench_classify", f"""WITH r AS ({_RULED}), s AS (SELECT *, {_STATUS} AS status, CASE WHEN n % 5 > 0 THEN {_LIST}[n % {len(NAMES)} + 1] END AS expected FROM r),
  g AS (SELECT *, CASE WHEN status = 'include' THEN {_LIST}[n % {len(NAMES)} + 1] END AS got FROM s)
  SELECT count(*) AS messages, count(*) FILTER (WHERE got IS NOT DISTINCT FROM expected AND status <> 'failed') AS hits, round(count(*) FILTER (WHERE got IS NOT DISTINCT FROM expected AND status <> 'failed') / count(*), 6) AS hit_rate,
    count(*) FILTER (WHERE expected IS NULL AND got IS NOT NULL) AS false_positives, count(*) FILTER (WHERE status = 'failed') AS failed FROM g""")
def bench_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    expected = F.when(n % 5 > 0, F.element_at(F.array(*map(F.lit, NAMES)), n % len(NAMES) + 1))
    message = F.struct("seq", "content", expected.alias("expected"))
    made = _batches(spark, sf_dir).groupBy(F.col("batch_id").alias("case_id")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return runners.classify_report(runners.run_classify(made, StubClassifier, NAMES)).withColumn("hit_rate", F.round("hit_rate", 6))


def _side(items: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    return items.select(F.col("id").alias(key), F.struct(*[F.col(f).alias(a) for f, a in zip(fields[::2], fields[1::2], strict=True)]).alias(name))


def dedup_bench_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of equal texts and of neighbours with other texts, from all cards."""
    items = frame(spark, sf_dir, "items").withColumn("image_urls", F.array().cast("array<string>"))
    made = cases.dedup_cases(items)
    card = ("title", "title", "source_quote", "source_quote", "source", "source", "image_urls", "image_urls")
    rows = made.join(_side(items, "item_id", "item", *card), "item_id").join(_side(items, "query_id", "query", *card), "query_id")
    return rows.select(F.concat_ws("-", "same", "item_id", "query_id").alias("case_id"), F.array("item").alias("items"), "query", "same")


_DEDUP = """f AS (SELECT content_hash, min(id) AS first_id FROM items GROUP BY 1), n AS (SELECT id, content_hash, lag(id) OVER w AS head, lag(content_hash) OVER w AS h0 FROM items WINDOW w AS (PARTITION BY session_id, category ORDER BY msg_time, id)),
  c AS (SELECT first_id AS a, id AS b, true AS expected FROM items JOIN f USING (content_hash) WHERE id > first_id UNION ALL SELECT head, id, false FROM n WHERE head IS NOT NULL AND h0 <> content_hash),
  e AS (SELECT expected, coalesce(x.source_quote, '') <> '' AND x.source_quote = y.source_quote AS exact, concat_ws(chr(10), x.title, x.source_quote) = concat_ws(chr(10), y.title, y.source_quote) AS alike FROM c JOIN items x ON x.id = a JOIN items y ON y.id = b),
  p AS (SELECT *, exact OR alike AS predicted FROM e)"""
_RATES = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_COUNTS = "count(*) FILTER (WHERE expected AND predicted) AS tp, count(*) FILTER (WHERE NOT expected AND predicted) AS fp, count(*) FILTER (WHERE NOT expected AND NOT predicted) AS tn, count(*) FILTER (WHERE expected AND NOT predicted) AS fn"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in ("accuracy", "precision", "recall", "f1")})


@query("bench_dedup", f"{ctes('items')}, {_DEDUP}, k AS (SELECT {_COUNTS}, count(*) FILTER (WHERE exact) AS channel_exact, count(*) AS cases FROM p) SELECT *, {_RATES} FROM k")
def bench_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = runners.dedup_report(runners.run_dedup(dedup_bench_cases(spark, sf_dir), StubProvider))
    every = sum((F.col(f"channel_{c}") for c in metrics.CHANNELS), F.lit(0).cast("long"))
    return _rounded(report.withColumn("cases", every)).select("tp", "fp", "tn", "fn", "channel_exact", "cases", "accuracy", "precision", "recall", "f1")


@query("bench_merge", f"""{ctes('items')}, n AS (SELECT id, subject, msg_time, title, source_quote, lag(id) OVER w AS head, lag(subject) OVER w AS s0, lag(msg_time) OVER w AS t0, lag(title) OVER w AS title0, lag(source_quote) OVER w AS q0 FROM items WINDOW w AS (PARTITION BY session_id, category ORDER BY msg_time, id)),
  p AS (SELECT coalesce(subject <> '' AND subject = s0 AND msg_time - t0 <= 86400, false) AS expected, concat_ws(chr(10), title, source_quote) = concat_ws(chr(10), title0, q0) AS predicted FROM n WHERE head IS NOT NULL), k AS (SELECT {_COUNTS} FROM p) SELECT *, {_RATES} FROM k""")
def bench_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frame(spark, sf_dir, "items")
    text = ("title", "title", "source_quote", "content")
    made = cases.merge_cases(items, 86_400).join(_side(items, "head_id", "head", *text), "head_id").join(_side(items, "tail_id", "tail", *text), "tail_id")
    evals = runners.run_merge(made.select(F.col("tail_id").alias("case_id"), "head", "tail", "merge"), StubProvider)
    return _rounded(metrics.binary_metrics(evals.where("error IS NULL"), "expected", "predicted")).select("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")


@query("bench_title", f"""{ctes('items')}, t AS (SELECT title, coalesce(source_quote, '') AS content, list_filter(list_transform(regexp_split_to_array(coalesce(key_info, ''), '[,，、]'), lambda x: trim(x)), lambda x: x <> '') AS keywords FROM items WHERE is_verified <> -1 AND coalesce(title, '') <> ''),
  g AS (SELECT *, nullif(substring(trim(string_split(trim(content), chr(10))[1]), 1, 50), '') AS made FROM t), e AS (SELECT *, coalesce(made, title) AS shown FROM g),
  h AS (SELECT *, len(keywords) > 0 AS asked, len(list_filter(keywords, lambda k: NOT contains(shown, k))) = 0 AS got FROM e)
  SELECT count(*) AS cases, round(coalesce(count(*) FILTER (WHERE asked AND got) / nullif(count(*) FILTER (WHERE asked), 0), 0), 6) AS keyword_rate, round(avg(length(shown)), 6) AS mean_length, round(count(*) FILTER (WHERE length(shown) > 20) / count(*), 6) AS too_long_rate, round(count(*) FILTER (WHERE made IS NULL) / count(*), 6) AS fallback_rate FROM h""")
def bench_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cases.title_cases(frame(spark, sf_dir, "items")).select("case_id", F.col("expected_title").alias("old_title"), F.coalesce("source_quote", F.lit("")).alias("content"), "expected_title", "keywords")
    evals = runners.run_title(made, StubProvider)
    report = metrics.title_metrics(evals).crossJoin(F.broadcast(evals.agg(F.count("*").alias("cases"))))  # a row each
    return report.select("cases", *[F.round(c, 6).alias(c) for c in ("keyword_rate", "mean_length", "too_long_rate", "fallback_rate")])
