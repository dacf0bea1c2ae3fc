"""Counters, percentiles and quality metrics of the decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.times import is_echo


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("kind", "source").agg(F.count("*").alias("n"))


def latency_stats(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum and linearly interpolated p50, p95 and p99."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), p.alias("p"))
    return out.select(*keys, "n", "total", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def binary_metrics(evals: DataFrame, expected: str, got: str, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and F1 of booleans; empty denominators give 0."""
    e, g = F.col(expected), F.col(got)
    n = {"tp": e & g, "fp": ~e & g, "tn": ~e & ~g, "fn": e & ~g}
    counts = evals.groupBy(*(keys or [])).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    tp, fp, tn, fn = (F.col(k) for k in n)
    rated = counts.withColumns({"accuracy": safe_ratio(tp + tn, tp + fp + tn + fn), "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn)})
    return rated.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: What decided a near-duplicate case.
CHANNELS = ("exact", "cosine", "overlap", "cosine_no_candidate", "none")


def channel_distribution(evals: DataFrame) -> DataFrame:
    """One row over the cases without an error (channel, cosine_ran, skipped, error): how many each channel decided, how many
    had vectors compared, and how many a judge was asked about, with their share."""
    valid = evals.where(F.col("error").isNull())
    judged = F.count_if(~F.col("skipped"))
    counts = [F.count_if(F.col("channel") == c).alias(f"channel_{c}") for c in CHANNELS]
    return valid.agg(*counts, F.count_if("cosine_ran").alias("cosine_cases"), judged.alias("judged_cases"), safe_ratio(judged, F.count("*")).alias("judged_rate"))


def classify_case_metrics(expected: DataFrame, got: DataFrame, messages: DataFrame) -> DataFrame:
    """Per (case_id, idx): category hit, false positive, hits, misses and extras of time points, echoes set apart.

    expected and got: case_id, idx, category, points array<struct<type,time>>; messages: case_id, idx, sent (epoch).
    """
    e = expected.select("case_id", "idx", F.col("category").alias("want"), F.col("points").alias("want_points"))
    g = got.select("case_id", "idx", F.col("category").alias("have"), F.col("points").alias("have_points"))
    rows = e.join(g, ["case_id", "idx"], "full_outer").join(messages.select("case_id", "idx", "sent"), ["case_id", "idx"], "left")
    none = F.array().cast("array<struct<type:string,time:string>>")
    want, have = F.coalesce("want_points", none), F.coalesce("have_points", none)
    real = F.filter(want, lambda p: ~is_echo(p["time"], F.col("sent")))
    size = lambda c: F.size(c)
    return rows.select(
        "case_id", "idx",
        F.coalesce(F.col("want") == F.col("have"), F.lit(False)).alias("category_hit"),
        (F.col("want").isNull() & F.col("have").isNotNull()).alias("false_positive"),
        size(F.array_intersect(want, have)).alias("point_hits"),
        size(F.array_except(want, have)).alias("point_misses"),
        size(F.array_except(have, want)).alias("point_extras"),
        (size(want) - size(real)).alias("echo_points"),
        size(F.filter(real, lambda p: F.length(p["time"]) == 10)).alias("date_points"),
        size(F.filter(real, lambda p: F.length(p["time"]) > 10)).alias("clock_points"),
    )


def by_mode(evals: DataFrame, value: str = "hit") -> DataFrame:
    """Cases, hits and rate by mode and, with mode null, over all."""
    out = evals.rollup("mode").agg(F.count("*").alias("n"), F.count_if(F.col(value)).alias("hits"), F.grouping("mode").alias("is_total"))
    return out.withColumn("rate", safe_ratio(F.col("hits"), F.col("n")))


def title_metrics(evals: DataFrame, most: int = 20) -> DataFrame:
    """evals (title, similarity, keywords, fallback): keyword-all rate, length, similarity, too long, fallback."""
    every = F.forall("keywords", lambda k: F.contains(F.col("title"), k))
    return evals.agg(
        safe_ratio(F.count_if(every & (F.size("keywords") > 0)), F.count_if(F.size("keywords") > 0)).alias("keyword_rate"),
        F.avg(F.length("title")).alias("mean_length"), F.avg("similarity").alias("mean_similarity"), F.median("similarity").alias("median_similarity"),
        safe_ratio(F.count_if(F.length("title") > most), F.count("*")).alias("too_long_rate"), safe_ratio(F.count_if(F.col("fallback")), F.count("*")).alias("fallback_rate"),
    )


def shadow_summary(log: DataFrame) -> DataFrame:
    """One row: messages by agreement of two parsers, from their missing and extra lists."""
    missing, extra = F.size("missing_in_parser") > 0, F.size("extra_in_parser") > 0
    return log.agg(
        F.count("*").alias("messages"), F.count_if(~missing & ~extra).alias("equal"), F.count_if(missing & ~extra).alias("missing_only"),
        F.count_if(~missing & extra).alias("extra_only"), F.count_if(missing & extra).alias("both_differ"),
    )


def hint_misses(log: DataFrame) -> DataFrame:
    """Strong hints by pattern: seen and not resolved."""
    h = log.select(F.explode("hints").alias("h")).where("h.kind = 'strong'")
    return h.groupBy(F.col("h.pattern_id").alias("pattern_id")).agg(F.count("*").alias("n"), F.count_if(~F.col("h.resolved")).alias("missed"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float], score: str = "score", positive: str = "positive") -> DataFrame:
    """For each threshold: share of positives at or over it and share of all pairs that it triggers. One pass."""
    cells = [F.struct(F.lit(t).alias("threshold"), safe_ratio(F.count_if(F.col(positive) & (F.col(score) >= t)), F.count_if(F.col(positive))).alias("recall"), safe_ratio(F.count_if(F.col(score) >= t), F.count("*")).alias("trigger_rate")) for t in thresholds]
    return pairs.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def group_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def vector_inventory(rows: DataFrame) -> DataFrame:
    """(model, dim) counts of stored vectors; dim null where the vector is missing."""
    return rows.groupBy("model", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim")).agg(F.count("*").alias("n"))


def dominant_dimension(rows: DataFrame) -> DataFrame:
    """One row: the most frequent vector length, the larger on a tie."""
    n = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    return n.agg(F.max_by("dim", F.struct("n", "dim")).alias("dim"))


def migration_findings(rows: DataFrame, model: str, dim: int) -> DataFrame:
    """What is wrong with stored vectors for a model and length."""
    finding = F.when(F.col("dim").isNull(), "unreadable").when(F.col("model") != model, "other model").when(F.col("dim") != dim, "other length")
    return vector_inventory(rows).withColumn("finding", finding).where("finding IS NOT NULL")


def dataset_stats(cases: DataFrame) -> DataFrame:
    """Cases by feature and origin with positives and their share."""
    return cases.groupBy("feature", "origin").agg(F.count("*").alias("n"), F.count_if("positive").alias("positives")).withColumn("share", safe_ratio(F.col("positives"), F.col("n")))


def weighted_vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """votes (weight, same nullable): same holds when it has over half of the voted weight; failed votes count for neither."""
    voted = F.coalesce(F.sum(F.when(F.col("same").isNotNull(), F.col("weight"))), F.lit(0.0))
    same = F.coalesce(F.sum(F.when(F.col("same"), F.col("weight"))), F.lit(0.0))
    return votes.groupBy(*keys).agg(voted.alias("voted_weight"), same.alias("same_weight")).withColumn("duplicate", (F.col("voted_weight") > 0) & (F.col("same_weight") > F.col("voted_weight") / 2))


def unanimous(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Every vote is same; a failed vote is against."""
    return votes.groupBy(*keys).agg(F.bool_and(F.coalesce("same", F.lit(False))).alias("duplicate"))


def uncertain_counts(log: DataFrame, key: list[str]) -> DataFrame:
    """log (outcome uncertain or ok, version, ts): uncertain outcomes since the last success, with the version of the first."""
    last = log.where("outcome = 'ok'").groupBy(*key).agg(F.max("ts").alias("ok__"))
    open_ = log.where("outcome = 'uncertain'").join(last, key, "left").where("ok__ IS NULL OR ts > ok__")
    return open_.groupBy(*key).agg(F.count("*").alias("uncertain_count"), F.min_by("version", F.struct("ts", "version")).alias("version"))


def expected_rank(scores: DataFrame) -> DataFrame:
    """scores (id, expected, category, score): the rank of the expected category and its margin to the best rival."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "category"))
    r = scores.withColumn("rank", rank)
    own = F.col("category") == F.col("expected")
    return r.groupBy("id").agg(F.max(F.when(own, F.col("rank"))).alias("rank"), (F.max(F.when(own, F.col("score"))) - F.max(F.when(~own, F.col("score")))).alias("margin"))


def sync_progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """events (keys, seq, started, finished) with pending, new_count, processed_count and done after each of them.

    Pending never falls below 0. A start when nothing is pending opens a new burst, whose counts begin at 0.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = events.withColumn("level", F.sum(F.col("started") - F.col("finished")).over(w))
    rows = rows.withColumn("pending", F.col("level") - F.least(F.lit(0), F.min("level").over(w)))
    opens = (F.col("started") > 0) & (F.coalesce(F.lag("pending").over(w), F.lit(0)) == 0)
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("burst", F.sum("opens").over(w))
    own = Window.partitionBy(*keys, "burst").orderBy("seq")
    return rows.withColumns({"new_count": F.sum("started").over(own), "processed_count": F.sum("finished").over(own), "done": F.col("pending") == 0}).drop("level", "opens", "burst")
