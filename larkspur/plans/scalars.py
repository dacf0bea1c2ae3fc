"""Queries of scalar functions, parsers and small mutations over the message store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import jsonx, text, times
from larkspur.operators import cases, filters, joins, metrics, retrieval, sets, state
from larkspur.plans.frames import ctes, frame, table_of
from larkspur.plans.registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "events")


@query("title_overlap_scores", """WITH p AS (SELECT event_id, replace(concat(event_type, ' ', user_id), ' ', '') AS a, replace(concat(event_type, ' ', event_id % 40), ' ', '') AS b FROM events),
  g AS (SELECT event_id, list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) AS y FROM p)
  SELECT event_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS overlap FROM g""")
def title_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat_ws(" ", "event_type", "user_id"), F.concat_ws(" ", F.col("event_type"), F.col("event_id") % 40)
    return _events(spark, sf_dir).select("event_id", F.round(text.title_overlap(a, b), 6).alias("overlap"))


@query("judge_keys", "SELECT event_id, substring(sha256(concat(event_type, chr(0), event_id % 97)), 1, 16) AS judge_key, substring(sha256(event_type), 1, 12) AS hidden_id FROM events")
def judge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", text.judge_key(F.col("event_type"), (F.col("event_id") % 97).cast("string")).alias("judge_key"), text.digest(F.col("event_type"), 12).alias("hidden_id"))


@query("embedding_texts", "SELECT doc_id, length(substring(concat(source, ' ', coalesce(text, '')), 1, 2000)) AS n, sha256(substring(concat(source, ' ', coalesce(text, '')), 1, 400)) AS clipped FROM documents")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table_of(spark, sf_dir, "documents")
    joined = text.embedding_text(F.col("source"), F.col("text"))
    return d.select("doc_id", F.length(joined).alias("n"), F.sha2(text.clip(joined), 256).alias("clipped"))


@query("csv_cells", "WITH c AS (SELECT event_id, concat(CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN '-' ELSE '' END, event_type) AS cell FROM events) SELECT event_id, CASE WHEN regexp_matches(cell, '^[=+@-]') THEN concat('''', cell) ELSE cell END AS cell FROM c")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    first = F.when(n == 0, "=").when(n == 1, "@").when(n == 2, "-").otherwise("")
    return _events(spark, sf_dir).select("event_id", text.csv_cell(F.concat(first, F.col("event_type"))).alias("cell"))


#: Parameter names, and whether their values are secrets.
_PARAMETERS = {"access_token": True, "AccessToken": True, "page": False, "sig": True, "pwd": True, "token_id": True, "keyword": False, "tokenizer": False, "authorization": True, "api-key": True, "sec_ret": True, "x_auth_y": True, "monkey": True, "keyed": False}


@query("redacted_urls", "SELECT event_id, concat('/api?a=', user_id, '&', " + "CASE event_id % 14 " + " ".join(f"WHEN {i} THEN concat('{n}=', " + ("'***')" if hide else "event_type)") for i, (n, hide) in enumerate(_PARAMETERS.items())) + " END, '&q=', event_type) AS url FROM events")
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _PARAMETERS]), (F.col("event_id") % len(_PARAMETERS) + 1).cast("int"))
    url = F.concat(F.lit("/api?a="), F.col("user_id"), F.lit("&"), name, F.lit("="), F.col("event_type"), F.lit("&q="), F.col("event_type"))
    return _events(spark, sf_dir).select("event_id", text.redact_query(url).alias("url"))


@query("qr_noise", """SELECT event_id, concat(event_type, CASE event_id % 5 WHEN 0 THEN '，' WHEN 1 THEN '！' WHEN 2 THEN '，欢迎' WHEN 3 THEN '二维码在门口' ELSE '，该二维码，有效' END, user_id) AS cleaned FROM events""")
def qr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    note = F.when(n == 0, "该二维码7天内(9月1日前)有效，重新进入将更新").when(n == 1, "本二维码 7 天后失效！").when(n == 2, "该二维码于9月1日前有效，欢迎").when(n == 3, "二维码在门口").otherwise("，该二维码，有效")
    return _events(spark, sf_dir).select("event_id", text.strip_qr_noise(F.concat(F.col("event_type"), note, F.col("user_id"))).alias("cleaned"))


@query("media_paths", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat(page_id, '/images/a.jpg') WHEN 1 THEN '' END AS path FROM pages")
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 3
    url = F.when(n == 0, F.concat(F.lit("http://127.0.0.1:5033/api/v1/media/"), F.col("page_id"), F.lit("/images/a.jpg?access_token=1"))).when(n == 1, F.lit("/api/v1/media/")).otherwise(F.col("url"))
    return table_of(spark, sf_dir, "pages").select("page_id", text.media_path(url).alias("path"))


@query("keyword_split", "SELECT event_id, array_to_string([x for x in [trim(y) for y in string_split_regex(concat(event_type, ', ,', user_id, '、 ', event_id % 7), '[,，、]')] if x <> ''], '|') AS keywords FROM events")
def keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("event_type"), F.lit(", ,"), F.col("user_id"), F.lit("、 "), F.col("event_id") % 7)
    return _events(spark, sf_dir).select("event_id", F.array_join(text.split_keywords(raw), "|").alias("keywords"))


_RAW_TIME = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN '2024-02-30' ELSE 'tomorrow' END"


def _raw_time() -> Column:
    n = F.col("event_id") % 4
    return F.when(n == 0, F.date_format("ts", "yyyy-MM-dd")).when(n == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(n == 2, F.lit("2024-02-30")).otherwise(F.lit("tomorrow"))


@query("clean_times", f"SELECT event_id, CASE WHEN event_id % 4 < 2 THEN {_RAW_TIME} ELSE '' END AS cleaned FROM events")
def clean_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", times.clean_time(_raw_time()).alias("cleaned"))


@query("coerced_epochs", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) WHEN 2 THEN event_id END AS epoch, event_id % 4 = 3 AS bad FROM events")
def coerced_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    given = F.when(n < 2, _raw_time()).when(n == 2, F.col("event_id").cast("string")).otherwise(F.lit("soon"))
    return _events(spark, sf_dir).select("event_id", times.coerce_epoch(given).alias("epoch"), times.bad_time(given).alias("bad"))


@query("echo_points", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS echo FROM events")
def echo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", times.is_echo(_raw_time(), F.unix_timestamp("ts")).alias("echo"))


@query("reminder_minutes", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS remind_at FROM events")
def reminder_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _events(spark, sf_dir).select("event_id", times.reminder_minute(given).alias("remind_at"))


@query("backoff_steps", "SELECT event_id % 8 AS step, least(60 * power(2.0, event_id % 8), 600.0) AS seconds FROM events GROUP BY ALL")
def backoff_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _events(spark, sf_dir).select((F.col("event_id") % 8).alias("step")).distinct()
    return steps.withColumn("seconds", times.backoff_seconds(F.col("step")))


@query("image_sets", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE array_to_string(list_sort(list_distinct([concat('i', event_id % 4), concat('i', event_id % 3)])), ',') END AS images FROM events")
def image_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 3 == 2, F.lit("not a list")).otherwise(F.to_json(F.array(F.concat(F.lit("i"), e % 4), F.concat(F.lit("i"), e % 3))))
    return _events(spark, sf_dir).select("event_id", F.array_join(jsonx.string_set(raw), ",").alias("images"))


@query("parsed_points", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END AS points FROM events")
def parsed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point twice, and one of an unknown type: one valid point remains where the time is real."""
    point = lambda kind: F.struct(F.lit(kind).alias("type"), _raw_time().alias("time"), F.lit("x").alias("label"))
    raw = F.to_json(F.array(point("start"), point("start"), point("other")))
    return _events(spark, sf_dir).select("event_id", F.size(jsonx.time_points(raw)).alias("points"))


@query("quarantined_vectors", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE len(embedding) END AS dim FROM embeddings")
def quarantined_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("vec_id") % 5 == 0, F.lit("[1, null]")).otherwise(F.to_json("embedding"))
    v = jsonx.vector(raw)
    return table_of(spark, sf_dir, "embeddings").select("vec_id", F.when(v.isNotNull(), F.size(v)).alias("dim"))


@query("citation_marks", "SELECT event_id, CASE WHEN event_id % 9 BETWEEN 1 AND 5 THEN CAST(event_id % 9 AS VARCHAR) ELSE '' END AS cited FROM events")
def citation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.concat(F.lit("["), F.col("event_id") % 9, F.lit("]"))
    answer = F.concat(F.lit("It is so "), mark, F.lit(", as "), mark, F.lit(" says [99]."))
    return _events(spark, sf_dir).select("event_id", F.array_join(jsonx.citations(answer, F.lit(5)), ",").alias("cited"))


@query("cited_answers", "SELECT event_id, array_to_string(list_sort(list_distinct([n FOR n IN [event_id % 9, event_id % 4] IF n BETWEEN 1 AND 5])), ',') AS cited FROM events")
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('{"answer":"yes [5]","citations":['), F.col("event_id") % 9, F.lit(', "'), F.col("event_id") % 4, F.lit('", true, 2.5]}'))
    return _events(spark, sf_dir).withColumn("said", said).select("event_id", F.array_join(jsonx.cited_answer(F.col("said"), F.lit(5))["citations"], ",").alias("cited"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' ids, dealt to several tasks a core: a small file of many rows is few splits, and reading an answer is slow."""
    return _events(spark, sf_dir).select("event_id").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")


@query("summary_answers", "SELECT event_id, event_id % 7 AS idx, concat('Quote ', event_id % 301) AS summary FROM events WHERE event_id % 3 > 0")
def summary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced answers with one good entry, or with none where the index is no number."""
    idx = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7).cast("string")).otherwise("true")
    said = F.concat(F.lit('```json\n{"data":[{"index":'), idx, F.lit(',"summary":" Quote  '), F.col("event_id") % 301, F.lit(' ","subject":""}, 4]}\n```'))
    rows = _dealt(spark, sf_dir).withColumn("said", said).select("event_id", jsonx.parse_summaries(F.col("said")).alias("m"))
    # The outer form: for the inner one Spark adds a filter on the map, which reads each answer once more.
    return rows.select("event_id", F.explode_outer("m").alias("idx", "v")).where("idx IS NOT NULL").select("event_id", "idx", F.col("v.summary").alias("summary"))


@query("time_answers", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 WHEN event_id % 40 BETWEEN 1 AND 29 THEN 1 ELSE 0 END AS points FROM events")
def time_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a real day of February; answers of another task cannot be read (-1)."""
    day = F.lpad((F.col("event_id") % 40).cast("string"), 2, "0")
    task = F.when(F.col("event_id") % 4 == 0, "summarize").otherwise("times")
    said = F.concat(F.lit('{"task":"'), task, F.lit('","data":[{"index":0,"times":[{"type":"end","time":"2024-02-'), day, F.lit('"},{"type":"due","time":"2024-02-01"}]}]}'))
    rows = _dealt(spark, sf_dir).withColumn("said", said).select("event_id", jsonx.parse_times(F.col("said")).alias("m"))
    return rows.select("event_id", F.coalesce(F.size(F.try_element_at("m", F.lit(0).cast("bigint"))), F.lit(-1)).alias("points"))


@query("batch_fingerprints", """SELECT user_id, substring(sha256(concat('["', string_agg(CAST(event_id AS VARCHAR), '", "' ORDER BY CAST(event_id AS VARCHAR)), '"]')), 1, 16) AS fingerprint FROM events GROUP BY 1""")
def batch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(cases.batch_fingerprint("event_id").alias("fingerprint"))


@query("dominant_dimension", "SELECT len(embedding) AS dim FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1")
def dominant_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dominant_dimension(table_of(spark, sf_dir, "embeddings"))


@query("migration_findings", "WITH v AS (SELECT concat('m', label % 3) AS model, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE len(embedding) END AS dim FROM embeddings), f AS (SELECT *, CASE WHEN dim IS NULL THEN 'unreadable' WHEN model <> 'm1' THEN 'other model' WHEN dim <> 32 THEN 'other length' END AS finding FROM v) SELECT model, coalesce(dim, -1) AS dim, count(*) AS n, finding FROM f WHERE finding IS NOT NULL GROUP BY ALL")
def migration_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_of(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    return metrics.migration_findings(rows, "m1", 32).withColumn("dim", F.coalesce("dim", F.lit(-1)))


@query("held_out_overlap", "SELECT DISTINCT event_type AS fingerprint FROM events WHERE event_id % 2 = 0 AND event_type IN (SELECT event_type FROM events WHERE event_id % 2 = 1)")
def held_out_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumnRenamed("event_type", "fingerprint")
    return sets.overlap_violations(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@query("removed_keys", f"{ctes('items')} SELECT DISTINCT session_id FROM items WHERE session_id NOT IN (SELECT session_id FROM items WHERE id % 50 = 0)")
def removed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frame(spark, sf_dir, "items")
    return sets.removed_keys(items, items.where("id % 50 = 0"), ["session_id"])


@query("verified_flags", "SELECT DISTINCT e.user_id AS id, coalesce(CASE WHEN i.event_id % 6 = 0 THEN 1 WHEN i.event_id % 6 = 1 THEN -1 ELSE 0 END, 0) AS is_verified FROM events e LEFT JOIN events i ON i.event_id = e.user_id")
def verified_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.verified_flags(_events(spark, sf_dir).select(F.col("user_id").alias("id")), frame(spark, sf_dir, "items"))


@query("existing_ids", f"{ctes('items')} SELECT DISTINCT user_id AS id FROM events WHERE user_id IN (SELECT id FROM items)")
def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.existing_ids(_events(spark, sf_dir).select(F.col("user_id").alias("id")), frame(spark, sf_dir, "items"))


@query("insert_new", f"{ctes('items')} SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT id FROM items WHERE id % 2 = 0)")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.insert_new(frame(spark, sf_dir, "items").where("id % 2 = 0").select("id"), _events(spark, sf_dir).select(F.col("user_id").alias("id")), ["id"])


@query("rename_category", f"{ctes('items')} SELECT id, CASE WHEN category = 'click' THEN 'tap' ELSE category END AS category FROM items")
def rename_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rename_category(frame(spark, sf_dir, "categories"), frame(spark, sf_dir, "items"), "click", "tap")[1].select("id", "category")


@query("delete_category", f"{ctes('items')} SELECT id FROM items WHERE category <> 'click'")
def delete_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.delete_category(frame(spark, sf_dir, "categories"), frame(spark, sf_dir, "items"), "click", purge=True)[1].select("id")


@query("set_reminder", f"{ctes('items')} SELECT id, CASE WHEN id = 11 THEN '2024-05-01 08:00' ELSE coalesce(remind_at, '') END AS remind_at FROM items")
def set_reminder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.set_reminder(frame(spark, sf_dir, "items"), 11, "2024-05-01 08:00").select("id", F.coalesce("remind_at", F.lit("")).alias("remind_at"))


@query("contact_upsert", "SELECT DISTINCT user_id AS sender_id, CASE WHEN user_id % 2 = 0 THEN concat('new ', user_id) ELSE concat('old ', user_id) END AS display_name FROM events")
def contact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _events(spark, sf_dir).select(F.lit("app").alias("source"), F.col("user_id").alias("sender_id")).distinct()
    named = lambda p: F.concat(F.lit(p), F.col("sender_id"))
    old, new = u.withColumn("display_name", named("old ")), u.where("sender_id % 2 = 0").withColumn("display_name", named("new "))
    return state.upsert_contacts(old, new).select("sender_id", "display_name")


@query("new_vectors", "SELECT vec_id AS msg_id FROM embeddings WHERE label % 3 = 1 AND vec_id >= 100")
def new_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table_of(spark, sf_dir, "embeddings").select(F.lit("app").alias("source"), F.col("vec_id").alias("msg_id"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("created_at"))
    return joins.new_vectors(v, v.select("source", "msg_id"), "m1", "000000100").select("msg_id")


@query("title_metrics", "WITH t AS (SELECT concat(event_type, ' ', event_id % 97) AS title, (event_id % 100) / 100.0 AS similarity, event_type AS k, event_id % 9 = 0 AS fallback FROM events) SELECT round(avg(CAST(contains(title, k) AS INT)), 6) AS keyword_rate, round(avg(length(title)), 6) AS mean_length, round(avg(similarity), 6) AS mean_similarity, round(median(similarity), 6) AS median_similarity, round(avg(CAST(length(title) > 8 AS INT)), 6) AS too_long_rate, round(avg(CAST(fallback AS INT)), 6) AS fallback_rate FROM t")
def title_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.concat(F.col("event_type"), F.lit(" "), e % 97).alias("title"), ((e % 100) / 100.0).alias("similarity"), F.array("event_type").alias("keywords"), (e % 9 == 0).alias("fallback"))
    out = metrics.title_metrics(rows, 8)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("shadow_summary", "WITH s AS (SELECT event_id % 3 = 0 AS m, event_id % 4 = 0 AS x FROM events) SELECT count(*) AS messages, count(*) FILTER (WHERE NOT m AND NOT x) AS equal, count(*) FILTER (WHERE m AND NOT x) AS missing_only, count(*) FILTER (WHERE x AND NOT m) AS extra_only, count(*) FILTER (WHERE m AND x) AS both_differ FROM s")
def shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.when(F.col("event_id") % n == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>"))
    return metrics.shadow_summary(_events(spark, sf_dir).select(some(3).alias("missing_in_parser"), some(4).alias("extra_in_parser")))


@query("classify_metrics", """SELECT user_id AS case_id, event_id AS idx, event_id % 2 = 0 AS category_hit, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS point_hits, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS point_misses, 1 AS echo_points FROM events""")
def classify_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), F.col("event_id").alias("idx"), "event_type", F.unix_timestamp("ts").alias("sent"))
    point = F.struct(F.lit("start").alias("type"), times.local_minute(F.col("sent")).alias("time"))
    none = F.array().cast("array<struct<type:string,time:string>>")
    want = e.select("case_id", "idx", F.col("event_type").alias("category"), F.array(point).alias("points"))
    got = e.select("case_id", "idx", F.when(F.col("idx") % 2 == 0, F.col("event_type")).otherwise(F.lit("other")).alias("category"), F.when(F.col("idx") % 3 == 0, F.array(point)).otherwise(none).alias("points"))
    return metrics.classify_case_metrics(want, got, e).select("case_id", "idx", "category_hit", "point_hits", "point_misses", "echo_points")


@query("case_set_merge", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def case_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _events(spark, sf_dir).select(F.col("event_id").alias("id"))
    return cases.merge_case_sets(ids.where("id % 2 = 0").withColumn("version", F.lit("old")), ids.where("id % 3 = 0").withColumn("version", F.lit("new")))


@query("title_case_set", f"{ctes('items')} SELECT id, title AS expected_title FROM items WHERE is_verified <> -1")
def title_case_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frame(spark, sf_dir, "items")
    key = cases.stable_id(F.col("id").cast("string"), F.lit("title"))
    made = cases.title_cases(items).select("case_id", "expected_title")
    return items.select("id", key.alias("case_id")).join(made, "case_id").select("id", "expected_title")


@query("answer_status", "SELECT DISTINCT user_id AS question, CASE WHEN user_id % 7 = 0 THEN 'retrieve_error' WHEN user_id % 7 = 1 THEN 'cancelled' WHEN user_id % 5 = 0 THEN 'refused' WHEN user_id % 3 = 0 THEN 'answer_error' ELSE 'answered' END AS status FROM events")
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _events(spark, sf_dir).select(F.col("user_id").alias("question")).distinct()
    hits = _events(spark, sf_dir).where("user_id % 5 <> 0").select(F.col("user_id").alias("question"))
    answers = questions.where("question % 3 <> 0").withColumn("answer", F.lit("yes [1]"))
    asked = questions.withColumns({"retrieve_failed": F.col("question") % 7 == 0, "cancelled": F.col("question") % 7 == 1})
    return retrieval.answer_status(asked, hits, answers)


@query("category_seeds", """SELECT * FROM (VALUES (1, '活动通知', '#2563EB', 1), (2, '社团招新', '#7C3AED', 1), (3, '学术', '#059669', 1), (4, '交易', '#D97706', 1), (5, '实习', '#DB2777', 1), (6, '失物招领', '#DC2626', 0),
  (7, '求助互助', '#EA580C', 0), (8, '组队拼团', '#0891B2', 0), (9, '兼职家教', '#CA8A04', 0), (10, '免费福利', '#16A34A', 0), (11, '房屋租售', '#9333EA', 0), (12, '志愿公益', '#0D9488', 0), (13, '奖助申报', '#BE185D', 0)) t(id, name, color, enabled)""")
def category_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.seed_categories(spark).select("id", "name", "color", "enabled")


@query("display_names", "SELECT event_id, concat('User ', user_id) AS name FROM events")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", text.clean_display_name(F.concat(F.lit("  User "), F.col("user_id"), F.lit("\x07\n "))).alias("name"))


@query("placeholders_only", "SELECT event_id, event_id % 2 = 0 AS only FROM events")
def placeholders_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", text.is_placeholder_only(F.when(F.col("event_id") % 2 == 0, "[图片]").otherwise(F.concat(F.lit("[图片] "), F.col("event_type")))).alias("only"))
