"""Queries of decisions: candidates, votes, allocation, retrieval, metrics, cases, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions.vectors import cosine
from larkspur.operators import cases, dedup, filters, joins, lists, merge, metrics, neighbours, retrieval, sets, state
from larkspur.plans.frames import ctes, frame, table_of
from larkspur.plans.registry import query
from larkspur.plans.stores import bm25_sql
from larkspur.ports.ai import StubProvider, StubTopicJudge, embed, judge_pairs, judge_topics
from larkspur.operators.survivors import SurvivorStore
from larkspur.schemas import Settings
from larkspur.scratch import scratch_path, written

_PAIRS = """p AS (SELECT n.source, n.session_id, n.category, n.id AS new_id, n.msg_time AS new_time, i.id AS cand_id, i.msg_time AS cand_time,
  row_number() OVER (PARTITION BY n.id ORDER BY i.msg_time, i.id) AS rank FROM new_items n JOIN items i ON i.source = n.source AND i.session_id = n.session_id AND i.category = n.category
  WHERE i.is_verified = 0 AND i.id <> n.id AND i.msg_time BETWEEN n.msg_time - 36000 AND n.msg_time + 36000)"""


@query("merge_candidates", f"{ctes('items', 'new_items')}, {_PAIRS} SELECT new_id, cand_id, cand_time, CAST(rank AS INT) AS rank FROM p WHERE rank <= 3")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a band join on time within session and category, ranked."""
    return joins.merge_candidates(frame(spark, sf_dir, "new_items"), frame(spark, sf_dir, "items"), 36_000).select("new_id", "cand_id", "cand_time", "rank")


@query("adjacent_pairs", f"{ctes('items')} SELECT * FROM (SELECT lag(id) OVER (PARTITION BY session_id, category ORDER BY msg_time, id) AS head_id, id AS tail_id FROM items) WHERE head_id IS NOT NULL")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.adjacent_pairs(frame(spark, sf_dir, "items"), ["session_id", "category"], ["msg_time", "id"], "id").select("head_id", "tail_id")


@query("hash_duplicates", f"{ctes('doc_cards')}, f AS (SELECT content_hash, min(id) AS first_id FROM doc_cards GROUP BY 1) SELECT first_id, id AS later_id, content_hash FROM doc_cards JOIN f USING (content_hash) WHERE id > first_id")
def hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.same_hash_pairs(frame(spark, sf_dir, "doc_cards"), "content_hash", "id")


@query("image_set_duplicates", "WITH k AS (SELECT event_id, user_id % 5 AS s, concat(least(user_id % 6, event_id % 4), '-', greatest(user_id % 6, event_id % 4)) AS k FROM events), f AS (SELECT s, k, min(event_id) AS cand_seq FROM k GROUP BY ALL) SELECT event_id AS seq, cand_seq FROM k JOIN f USING (s, k) WHERE event_id > cand_seq")
def image_set_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("user_id") % 6, F.col("event_id") % 4
    cards = table_of(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).cast("string").alias("source"), F.array(a.cast("string"), b.cast("string"), a.cast("string")).alias("image_urls"), F.lit("").alias("content_hash"))
    return dedup.exact_pairs(cards).where("channel = 'image'").select("seq", "cand_seq")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substring({0}, CAST(i AS INT), 2)))"


_PARTS = "SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand, p_type) AS title FROM part"


def _part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))


@query("overlap_best", f"""WITH p AS ({_PARTS}), d AS (SELECT id, replace(title, ' ', '') AS t FROM p), g AS (SELECT id, {_GRAMS.format('t')} AS g FROM d),
  e AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM g), q AS (SELECT * FROM e WHERE id % 20 = 0),
  s AS (SELECT q.id AS q_id, e.id, count(*) / (any_value(q.n) + any_value(e.n) - count(*)) AS score FROM q JOIN e USING (gram) WHERE q.id <> e.id GROUP BY ALL)
  SELECT q_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1""")
def overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _part_titles(spark, sf_dir)
    q = t.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("title").alias("q_title"))
    return joins.best_overlap(q, t, skip_same_id=True).select("q_id", "id", F.round("score", 6).alias("score"))


@query("title_overlap_pairs", f"""WITH p AS ({_PARTS}), d AS (SELECT id, replace(title, ' ', '') AS t, lead(replace(title, ' ', '')) OVER (PARTITION BY id % 97 ORDER BY id) AS u FROM p)
  SELECT id, round(len(list_intersect({_GRAMS.format('t')}, {_GRAMS.format('u')})) / len(list_distinct({_GRAMS.format('t')} || {_GRAMS.format('u')})), 6) AS score FROM d WHERE u IS NOT NULL""")
def title_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _part_titles(spark, sf_dir).select("id", "title", F.lead("title").over(Window.partitionBy(F.col("id") % 97).orderBy("id")).alias("following"))
    return t.where("following IS NOT NULL").select("id", F.round(text.title_overlap(F.col("title"), F.col("following")), 6).alias("score"))


@query("cosine_topk", f"""{ctes('vectors')}, s AS (SELECT q.id AS q_id, v.id, list_cosine_similarity(q.vec, v.vec) AS sim FROM vectors q, vectors v WHERE q.id % 20 = 0 AND v.id <> q.id)
  SELECT q_id, id, round(sim, 5) AS sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 3""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "vectors")
    q = v.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    others = neighbours.top_k(q, v, 4, -1.0).where("q_id <> id")  # a query's own row is not its neighbour
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
    return others.withColumn("rank", rank).where("rank <= 3").select("q_id", "id", F.round("sim", 5).alias("sim"), F.col("rank").cast("int").alias("rank"))


_PROTOTYPES = "p AS (SELECT * FROM vectors)"


@query("class_p5_threshold", f"{ctes('vectors')}, {_PROTOTYPES}, s AS (SELECT a.category, list_cosine_similarity(a.vec, b.vec) AS sim FROM p a JOIN p b ON a.category = b.category AND a.id < b.id) SELECT category, round(greatest(0, least(1, quantile_cont(sim, 0.05))), 5) AS threshold FROM s GROUP BY 1")
def class_p5_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir, "vectors")
    return neighbours.class_thresholds(p).join(p.groupBy("category").count().where("count > 1"), "category").select("category", F.round("threshold", 5).alias("threshold"))


@query("class_allocation", f"""{ctes('vectors')}, {_PROTOTYPES}, s AS (SELECT q.id AS q_id, p.category, CASE WHEN count(*) <= 3 THEN avg(list_cosine_similarity(q.vec, p.vec)) ELSE max(list_cosine_similarity(q.vec, p.vec)) END AS score FROM vectors q, p WHERE q.id % 20 = 0 AND q.id <> p.id GROUP BY ALL),
  w AS (SELECT q_id, max(struct_pack(s := score, c := category)) AS w FROM s WHERE score >= 0.2 GROUP BY 1), t AS (SELECT q_id, max(struct_pack(s := score, c := category)) AS t FROM s GROUP BY 1),
  m AS (SELECT t.q_id, w.w.c AS category, coalesce(w.w.c, t.t.c) AS top, coalesce(w.w.s, t.t.s) AS score FROM t LEFT JOIN w USING (q_id))
  SELECT m.q_id, coalesce(m.category, -1) AS category, round(m.score, 5) AS score, arg_max(s.category, s.score) AS runner_up FROM m JOIN s ON s.q_id = m.q_id AND s.category <> m.top GROUP BY ALL""")
def class_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "vectors")
    scores = neighbours.class_scores(v.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), v, skip_same_id=True)
    got = neighbours.allocate(scores, v.select("category").distinct().withColumn("threshold", F.lit(0.2)))
    return got.where("runner_up IS NOT NULL").select("q_id", F.coalesce("category", F.lit(-1)).alias("category"), F.round("score", 5).alias("score"), "runner_up")


@query("prototype_calibration", f"""{ctes('vectors')}, {_PROTOTYPES}, s AS (SELECT a.id, a.category, b.category AS class, CASE WHEN count(*) <= 3 THEN avg(list_cosine_similarity(a.vec, b.vec)) ELSE max(list_cosine_similarity(a.vec, b.vec)) END AS score FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
  e AS (SELECT id, category, max(score) FILTER (WHERE class = category) AS own, max(score) FILTER (WHERE class <> category) AS rival FROM s GROUP BY ALL)
  SELECT category, round(quantile_cont(own, 0.25), 5) AS own_p25, round(quantile_cont(rival, 0.75), 5) AS rival_p75 FROM e GROUP BY 1""")
def prototype_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir, "vectors")
    return neighbours.calibrate(p).select("category", F.round("own_p25", 5).alias("own_p25"), F.round("rival_p75", 5).alias("rival_p75"))


@query("correction_overlay", f"{ctes('items')} SELECT l.event_id AS item_id, concat('new ', l.event_type) AS category, coalesce(nullif(i.source_quote, ''), 'logged') AS content FROM events l LEFT JOIN (SELECT * FROM items WHERE id % 3 <> 0) i ON i.id = l.event_id WHERE l.event_id % 7 = 0 AND CAST(l.ts AS DATE) >= DATE '2024-01-10'")
def correction_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table_of(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("item_id"), F.concat(F.lit("new "), F.col("event_type")).alias("category_after"), F.lit("logged").alias("content"), F.col("ts").alias("created_at"))
    return joins.correction_overlay(log, frame(spark, sf_dir, "items").where("id % 3 <> 0"), "2024-01-10")


@query("sample_union_dedup", f"{ctes('items')}, u AS (SELECT source_quote AS content, 1.0 AS weight FROM items WHERE trim(source_quote) <> '' UNION ALL SELECT source_quote, 2.0 FROM items WHERE id % 9 = 0 AND trim(source_quote) <> '') SELECT content, CAST(max(weight) AS DOUBLE) AS weight FROM u GROUP BY 1")
def sample_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame(spark, sf_dir, "items").where("trim(source_quote) <> ''").select(F.col("source_quote").alias("content"), "category", "id")
    return lists.heaviest_by_content(sets.union_samples(s, s.where("id % 9 = 0"))).select("content", "weight")


@query("rrf_fusion", """WITH v AS (SELECT event_id % 50 AS question, event_id AS msg_id, row_number() OVER (PARTITION BY event_id % 50 ORDER BY value DESC, event_id) AS r FROM events), k AS (SELECT event_id % 50 AS question, event_id AS msg_id, row_number() OVER (PARTITION BY event_id % 50 ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'click'),
  a AS (SELECT * FROM v WHERE r <= 12), b AS (SELECT * FROM k WHERE r <= 12) SELECT coalesce(a.question, b.question) AS question, coalesce(a.msg_id, b.msg_id) AS msg_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS rrf, b.r IS NOT NULL AS has_keyword FROM a FULL JOIN b ON a.question = b.question AND a.msg_id = b.msg_id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table_of(spark, sf_dir, "events").withColumns({"question": F.col("event_id") % 50, "source": F.lit("app"), "msg_id": F.col("event_id")})
    ranked = lambda df, order: df.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where("rank <= 12")
    v = ranked(e, [F.desc("value"), "event_id"]).withColumn("cos", F.lit(0.5))
    k = ranked(e.where("event_type = 'click'"), [F.desc("ts"), "event_id"])
    return retrieval.fuse(v, k).select("question", "msg_id", F.round("rrf", 9).alias("rrf"), "has_keyword")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "documents").select(F.lit("app").alias("source"), F.col("doc_id").alias("msg_id"), F.col("text").alias("content"), F.lit("").alias("sender_name"), F.col("source").alias("group_name"), F.col("doc_id").alias("msg_time"))


@query("keyword_substring", "SELECT doc_id AS msg_id FROM documents WHERE contains(lower(text), 'of') AND contains(lower(text), 'the') AND contains(lower(text), 're') ORDER BY doc_id DESC LIMIT 50".replace("lower(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
def keyword_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.substring_search(_chunks(spark, sf_dir), "Of the RE", 50).select("msg_id")


@query("bm25_rank", bm25_sql(["tion ereres"], 50, "SELECT source AS group_name, doc_id AS msg_id, text FROM documents").replace("question, source, msg_id, score, rank", "msg_id, score"))
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question by a scan of all texts."""
    return retrieval.bm25_search(_chunks(spark, sf_dir), "tion ereres", 50).select("msg_id", F.round("score", 6).alias("score"))


@query("hybrid_retrieval")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question through both legs, fusion, the gate and evidence; vectors come from the stub provider."""
    chunks = _chunks(spark, sf_dir)
    question = "tion ereres"
    vecs = embed(chunks.select(F.col("msg_id").alias("id"), "content"), F.col("content"), StubProvider).select("id", "vec")
    q = spark.createDataFrame([(question,)], "q_id string")
    near = neighbours.top_k(embed(q, F.col("q_id"), StubProvider, "q_vec"), vecs, 12, 0.05)
    v = near.select(F.col("q_id").alias("question"), F.lit("app").alias("source"), F.col("id").alias("msg_id"), "rank", F.col("sim").alias("cos"))
    k = retrieval.keyword_search(chunks, question).select(F.lit(question).alias("question"), "source", "msg_id", "rank")
    return retrieval.retrieve(v, k, chunks).select("question", "msg_id", "n", F.round("rrf", 6).alias("rrf"), "has_keyword")


_EVALS = "e AS (SELECT l.doc_id, d.lang AS mode, l.quality = 1 AS expected, d.n_chars > 600 AS got FROM labels l JOIN documents d USING (doc_id))"
_COUNTS = "count(*) FILTER (WHERE expected AND got) AS tp, count(*) FILTER (WHERE NOT expected AND got) AS fp, count(*) FILTER (WHERE NOT expected AND NOT got) AS tn, count(*) FILTER (WHERE expected AND NOT got) AS fn"
_RATES = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table_of(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("mode"), (F.col("n_chars") > 600).alias("got"))
    return table_of(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("expected")).join(d, "doc_id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("binary_metrics", f"WITH {_EVALS}, c AS (SELECT {_COUNTS} FROM e) SELECT *, {_RATES} FROM c")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(_evals(spark, sf_dir), "expected", "got"), "accuracy", "precision", "recall", "f1")


@query("binary_metrics_by_mode", f"WITH {_EVALS}, c AS (SELECT mode, {_COUNTS} FROM e GROUP BY mode) SELECT *, {_RATES} FROM c")
def binary_metrics_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(_evals(spark, sf_dir), "expected", "got", ["mode"]), "accuracy", "precision", "recall", "f1")


@query("metrics_by_mode", f"WITH {_EVALS} SELECT mode, count(*) AS n, count(*) FILTER (WHERE got) AS hits, round(avg(CAST(got AS INT)), 6) AS rate FROM e GROUP BY ROLLUP (mode)")
def metrics_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.by_mode(_evals(spark, sf_dir), "got"), "rate").select("mode", "n", "hits", "rate")


@query("channel_distribution", "WITH c AS (SELECT CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'cosine' WHEN 2 THEN 'overlap' WHEN 3 THEN 'cosine_no_candidate' ELSE 'none' END AS channel, event_id % 5 IN (1, 3) AS ran, event_id % 5 IN (0, 3, 4) AS skipped FROM events WHERE event_id % 11 <> 0) SELECT " + ", ".join(f"count(*) FILTER (WHERE channel = '{c}') AS channel_{c}" for c in ("exact", "cosine", "overlap", "cosine_no_candidate", "none")) + ", count(*) FILTER (WHERE ran) AS cosine_cases, count(*) FILTER (WHERE NOT skipped) AS judged_cases, round(count(*) FILTER (WHERE NOT skipped) / count(*), 6) AS judged_rate FROM c")
def channel_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    channel = F.element_at(F.array(*[F.lit(c) for c in metrics.CHANNELS]), (n + 1).cast("int"))
    error = F.when(F.col("event_id") % 11 == 0, "timeout")
    evals = table_of(spark, sf_dir, "events").select(channel.alias("channel"), n.isin(1, 3).alias("cosine_ran"), n.isin(0, 3, 4).alias("skipped"), error.alias("error"))
    return _rounded(metrics.channel_distribution(evals), "judged_rate")


@query("event_counters", "SELECT event_type AS kind, user_id AS source, count(*) AS n FROM events GROUP BY ALL")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(table_of(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("source")))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.latency_stats(table_of(spark, sf_dir, "events"), ["event_type"], "value"), "p50", "p95", "p99").withColumn("total", F.round("total", 3))


@query("threshold_sweep", "WITH t AS (SELECT unnest([5.0, 20.0, 60.0]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, round(count(*) FILTER (WHERE event_type = 'purchase' AND value >= threshold) / count(*) FILTER (WHERE event_type = 'purchase'), 6) AS recall, round(count(*) FILTER (WHERE value >= threshold) / count(*), 6) AS trigger_rate FROM events, t GROUP BY threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table_of(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("positive"))
    return _rounded(metrics.threshold_sweep(e, [5.0, 20.0, 60.0]), "recall", "trigger_rate")


_VOTES = "v AS (SELECT user_id, CAST(1 + event_id % 3 AS DOUBLE) AS weight, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true WHEN 'error' THEN NULL ELSE false END AS same FROM events)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.when(F.col("event_type").isin("click", "view"), True).when(F.col("event_type") != "error", False)
    return table_of(spark, sf_dir, "events").select("user_id", (1 + F.col("event_id") % 3).cast("double").alias("weight"), same.alias("same"))


@query("weighted_vote", f"WITH {_VOTES}, w AS (SELECT user_id, coalesce(sum(weight) FILTER (WHERE same IS NOT NULL), 0) AS voted_weight, coalesce(sum(weight) FILTER (WHERE same), 0) AS same_weight FROM v GROUP BY 1) SELECT *, voted_weight > 0 AND same_weight > voted_weight / 2 AS duplicate FROM w")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_vote(_votes(spark, sf_dir), ["user_id"])


@query("unanimous_vote", f"WITH {_VOTES} SELECT user_id, weight, bool_and(coalesce(same, false)) AS duplicate FROM v GROUP BY ALL")
def unanimous_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unanimous(_votes(spark, sf_dir), ["user_id", "weight"])


@query("time_point_merge", f"""{ctes('items')}, p AS (SELECT session_id, 'start' AS type, "start" AS t FROM items WHERE "start" IS NOT NULL UNION ALL SELECT session_id, 'end', "end" FROM items WHERE "end" IS NOT NULL),
  m AS (SELECT session_id, min(t) FILTER (WHERE type = 'start') AS s, min(t) FILTER (WHERE type = 'end') AS e FROM p GROUP BY 1)
  SELECT m.session_id, s AS first_start, e AS first_end, count(DISTINCT CASE WHEN (p.type = 'start' AND p.t <> s) OR (p.type = 'end' AND p.t <> e) THEN concat(p.type, p.t) END) AS extras FROM m JOIN p USING (session_id) GROUP BY ALL""")
def time_point_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda kind: F.struct(F.lit(kind).alias("type"), F.col(kind).alias("time"), F.lit("").alias("label"))
    points = F.flatten(F.collect_list(F.filter(F.array(point("start"), point("end")), lambda p: p["time"].isNotNull())))
    rows = frame(spark, sf_dir, "items").groupBy("session_id").agg(points.alias("points"))
    start, end, extra = merge.merge_time_points(F.col("points"))
    return rows.select("session_id", start.alias("first_start"), end.alias("first_end"), F.size(extra).cast("bigint").alias("extras")).where("first_start IS NOT NULL OR first_end IS NOT NULL")


@query("ordered_set_merge", f"""{ctes('items')}, g AS (SELECT session_id, id, unnest(string_split(source_group, ', ')) AS name, generate_subscripts(string_split(source_group, ', '), 1) AS k FROM items), f AS (SELECT session_id, name, min(struct_pack(i := id, k := k)) AS place FROM g GROUP BY ALL)
  SELECT session_id, string_agg(name, ', ' ORDER BY place) AS source_group FROM f GROUP BY 1""")
def ordered_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "items").groupBy("session_id").agg(merge.merged_groups("source_group", "id").alias("source_group"))


@query("pair_diff", """WITH p AS (SELECT user_id, coalesce(list(event_type) FILTER (WHERE event_id % 2 = 0), []) AS a, coalesce(list(event_type) FILTER (WHERE event_id % 2 = 1), []) AS b FROM events GROUP BY user_id)
  SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS missing FROM p""")
def pair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda r: F.collect_list(F.when(F.col("event_id") % 2 == r, F.col("event_type")))
    rows = table_of(spark, sf_dir, "events").groupBy("user_id").agg(of(0).alias("a"), of(1).alias("b"))
    return sets.point_difference(rows, "a", "b").select("user_id", F.array_join("missing", ",").alias("missing"))


@query("session_upsert", "WITH o AS (SELECT DISTINCT user_id AS k, concat('old ', user_id) AS name, user_id % 2 AS enabled FROM events WHERE user_id % 3 <> 0), n AS (SELECT DISTINCT user_id AS k, concat('new ', user_id) AS name FROM events WHERE user_id % 2 = 0) SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, CAST(CASE WHEN o.k IS NOT NULL THEN o.enabled ELSE 1 END AS BIGINT) AS enabled FROM o FULL JOIN n ON o.k = n.k")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table_of(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct()
    old = u.where("k % 3 <> 0").select("k", F.concat(F.lit("old "), F.col("k")).alias("name"), (F.col("k") % 2).alias("enabled"))
    new = u.where("k % 2 = 0").select("k", F.concat(F.lit("new "), F.col("k")).alias("name"), F.lit(1).cast("bigint").alias("enabled"))
    return state.upsert(old, new, ["k"], ["name"])


@query("current_state", f"{ctes('items')}, l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT i.id, coalesce(l.v, i.category) AS category FROM items i LEFT JOIN l ON l.id = i.id")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table_of(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("category"), "event_id")
    return state.current(frame(spark, sf_dir, "items"), log, "category", ["event_id"]).select("id", "category")


@query("cascade_delete", f"{ctes('items')} SELECT id FROM items WHERE id % 13 <> 0")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frame(spark, sf_dir, "items")
    raw = items.select("source", F.col("source_msg_id").alias("msg_id"))
    kept, _, _ = state.delete_items(items, raw, items.select(F.col("id").alias("item_id")), items.where("id % 13 = 0").select("id"))
    return kept.select("id")


@query("purge_ignored", f"{ctes('items')} SELECT id FROM items WHERE is_verified = -1 AND verified_at < '2024-01-18T12:00:00'")
def purge_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.purge_ignored(frame(spark, sf_dir, "items"), 48, F.lit("2024-01-20 12:00:00").cast("timestamp"))


@query("recategorize_log", f"{ctes('items')} SELECT id AS item_id, category AS category_before, 'click' AS category_after FROM items WHERE id % 4 = 0 AND category <> 'click'")
def recategorize_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frame(spark, sf_dir, "items")
    _, log = state.recategorize(items, items.where("id % 4 = 0").select("id", F.lit("click").alias("new_category")), F.lit("2024-02-01"))
    return log.select("item_id", "category_before", "category_after")


@query("session_toggle", f"{ctes('sessions')} SELECT session_id, CASE WHEN session_id = 's5' THEN 1 - enabled ELSE enabled END AS enabled, coalesce(CASE WHEN session_id = 's5' AND enabled = 0 THEN NULL ELSE last_poll_ts END, -1) AS last_poll_ts FROM sessions")
def session_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.toggle_session(frame(spark, sf_dir, "sessions"), "app", "s5").select("session_id", "enabled", F.coalesce("last_poll_ts", F.lit(-1)).cast("bigint").alias("last_poll_ts"))


@query("vector_inventory", "SELECT concat('m', label % 3) AS model, CAST(len(embedding) AS INT) AS dim, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vector_inventory(table_of(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("label") % 3).alias("model"), "embedding"))


@query("dataset_stats", "SELECT d.lang AS feature, d.source AS origin, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positives, round(avg(quality), 6) AS share FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table_of(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("feature"), F.col("source").alias("origin"))
    rows = table_of(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive")).join(d, "doc_id")
    return _rounded(metrics.dataset_stats(rows), "share")


@query("dedup_case_pairs", f"""{ctes('items')}, f AS (SELECT content_hash, min(id) AS first_id FROM items GROUP BY 1), n AS (SELECT id, content_hash, lag(id) OVER w AS head, lag(content_hash) OVER w AS h0 FROM items WINDOW w AS (PARTITION BY session_id, category ORDER BY msg_time, id))
  SELECT first_id AS item_id, id AS query_id, true AS same FROM items JOIN f USING (content_hash) WHERE id > first_id UNION ALL SELECT head, id, false FROM n WHERE head IS NOT NULL AND h0 <> content_hash""")
def dedup_case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.dedup_cases(frame(spark, sf_dir, "items")).select("item_id", "query_id", "same")


@query("merge_case_pairs", f"""{ctes('items')}, n AS (SELECT id, subject, msg_time, lag(id) OVER w AS head_id, lag(subject) OVER w AS s0, lag(msg_time) OVER w AS t0 FROM items WINDOW w AS (PARTITION BY session_id, category ORDER BY msg_time, id))
  SELECT head_id, id AS tail_id, (subject <> '' AND subject = s0 AND msg_time - t0 <= 86400) AS merge FROM n WHERE head_id IS NOT NULL""")
def merge_case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.merge_cases(frame(spark, sf_dir, "items"), 86_400).select("head_id", "tail_id", "merge")


def dedup_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "vectors")
    titles = table_of(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("title"))
    texts = table_of(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source_quote"))
    urls = table_of(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.array(F.concat(F.lit("u"), F.col("user_id") % 40))).alias("image_urls"))
    rows = v.join(titles, "id", "left").join(texts, "id", "left").join(urls, "id", "left")
    return rows.select(F.col("id").alias("seq"), F.lit("app").alias("source"), F.coalesce("title", F.concat(F.lit("card "), F.col("category"))).alias("title"), "source_quote", "image_urls", F.when(F.col("id") % 4 > 0, F.col("vec")).alias("vec"))


@query("case_packing", f"""{ctes('items').replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT session_id AS grp, id, length(coalesce(source_quote, '')) AS n, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i FROM items WHERE is_verified <> -1 AND coalesce(trim(category), '') <> ''),
  f AS (SELECT grp, id, i, 0 AS case_no, 1 AS k, n AS used FROM c WHERE i = 1
    UNION ALL SELECT c.grp, c.id, c.i, CASE WHEN k < 8 AND used + n <= 2000 THEN case_no ELSE case_no + 1 END, CASE WHEN k < 8 AND used + n <= 2000 THEN k + 1 ELSE 1 END, CASE WHEN k < 8 AND used + n <= 2000 THEN used + n ELSE n END FROM f JOIN c ON c.grp = f.grp AND c.i = f.i + 1)
  SELECT grp AS "group", CAST(case_no AS INT) AS case_no, count(*) AS messages, substring(sha256('["' || array_to_string(list_sort(list(CAST(id AS VARCHAR))), '", "') || '"]'), 1, 16) AS fingerprint FROM f GROUP BY 1, 2""")
def case_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.classify_cases(frame(spark, sf_dir, "items")).select("group", "case_no", "messages", "fingerprint")


@query("greedy_dedup")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the embeddings table in order of id, in two runs over a store of survivors, with the stub judge; titles, texts and
    images come from parts, documents and events, so that every channel has cards to decide."""
    # The judge reads titles: the texts of its pairs need not come along.
    judge = lambda pairs: judge_pairs(pairs.drop("quote", "cand_quote"), F.substring("title", 1, 5), F.substring("cand_title", 1, 5), StubProvider)
    cards = dedup_cards(spark, sf_dir)
    store = SurvivorStore(spark, scratch_path(spark, "survivors"))
    half = cards.agg(F.expr("percentile_approx(seq, 0.5)").alias("m")).first()["m"] or 0
    runs = [store.run(part, judge, Settings(dedup_cosine=0.45, dedup_fallback=0.35)) for part in (cards.where(F.col("seq") <= half), cards.where(F.col("seq") > half))]
    return runs[0].unionByName(runs[1]).select("seq", "duplicate_of", "how", "channel", "asked")


@query("topic_merge")
def topic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge candidates judged by the stub on their titles and contents, then resolved in order and applied."""
    items = frame(spark, sf_dir, "items")
    cand = joins.merge_candidates(frame(spark, sf_dir, "new_items"), items, 360_000)
    side = lambda p: items.select(F.col("id").alias(f"{p}_id"), F.struct("title", "key_info", "source_quote").alias(f"{p}_card"), F.col("remind_at").isNotNull().alias(f"{p}_reminder"))
    rich = written(cand.join(side("new"), "new_id").join(side("cand"), "cand_id").withColumn("has_reminder", F.col("cand_reminder")), "rich")
    verdicts = judge_topics(rich.where("NOT has_reminder").select("new_id", "cand_id", "new_card", "cand_card"), "cand_card", "new_card", StubTopicJudge).select("new_id", "cand_id", "same")
    merges = merge.resolve_merges(rich, verdicts)
    return merge.merged_cards(items, merges).select("id", "msg_time", "source_group", "key_info")


@query("stub_verdicts")
def stub_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = frame(spark, sf_dir, "items").select("id", F.col("category").alias("a"), F.when(F.col("id") % 2 == 0, F.col("category")).otherwise(F.col("title")).alias("b"))
    return judge_pairs(pairs, F.col("a"), F.col("b"), StubProvider).select("id", "same")


@query("pair_cosines", f"{ctes('vectors')} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 5) AS cosine FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "vectors")
    pairs = v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(v.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return neighbours.pair_cosines(pairs, v).withColumn("cosine", F.round("cosine", 5))


@query("expected_rank", f"""{ctes('vectors')}, {_PROTOTYPES}, s AS (SELECT q.id, q.category AS expected, p.category, CASE WHEN count(*) <= 3 THEN avg(list_cosine_similarity(q.vec, p.vec)) ELSE max(list_cosine_similarity(q.vec, p.vec)) END AS score FROM vectors q, p WHERE q.id <> p.id GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS rank FROM s) SELECT id, max(rank) FILTER (WHERE category = expected) AS rank, round(max(score) FILTER (WHERE category = expected) - max(score) FILTER (WHERE category <> expected), 5) AS margin FROM r GROUP BY 1""")
def expected_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against all others, as the calibration takes each sample in turn."""
    v = frame(spark, sf_dir, "vectors")
    q = v.where("id IS NOT NULL")
    scores = neighbours.class_scores(q.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), q, skip_same_id=True)
    rows = scores.join(q.select(F.col("id").alias("q_id"), F.col("category").alias("expected")), "q_id").withColumnRenamed("q_id", "id")
    return metrics.expected_rank(rows).select("id", F.col("rank").cast("bigint").alias("rank"), F.round("margin", 5).alias("margin"))
