"""Files in and out: case sets, exports, snapshots and daily logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import csv_cell
from larkspur.functions.times import coerce_epoch

_MESSAGE = "struct<msg_id:string,content:string,sender_name:string,sender_id:string,session_id:string,group_name:string,timestamp:string,is_self:boolean,image_urls:array<string>,article_url:string,title:string,key_info:string>"
_CASE = (
    f"id:string,note:string,origin:string,batch_fingerprint:string,mode:string,messages:array<{_MESSAGE}>,items:array<{_MESSAGE}>,query:{_MESSAGE},"
    f"head:{_MESSAGE},tail:{_MESSAGE},message:{_MESSAGE},old_title:string,key_info:string,expected:string"
)
CASE_FILE = f"feature string, description string, categories array<struct<name:string,prompt:string,color:string>>, cases array<struct<{_CASE}>>, _corrupt_record string"


def read_cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The cases of JSON files, a row each, with feature and file; unreadable files give a row with `bad` and no case.

    Times of messages are strings or numbers upstream and become epoch seconds with `message_epoch`.
    """
    raw = spark.read.schema(CASE_FILE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(paths).withColumn("file", F.input_file_name())
    bad = raw["_corrupt_record"].isNotNull() | raw["feature"].isNull()
    return raw.select("file", "feature", bad.alias("bad"), F.explode_outer("cases").alias("case")).select("file", "feature", "bad", "case.*")


def message_epoch(c: Column) -> Column:
    return coerce_epoch(c)


def first_file_wins(cases: DataFrame) -> DataFrame:
    """Each (feature, id) once, from the first file by name."""
    rank = F.row_number().over(Window.partitionBy("feature", "id").orderBy("file"))
    return cases.where("NOT bad AND id IS NOT NULL").withColumn("rank", rank).where("rank = 1").drop("rank")


def file_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_distinct("file").alias("files"), F.count_distinct(F.when(F.col("bad"), F.col("file"))).alias("bad_files"))


def invalid_cases(cases: DataFrame) -> DataFrame:
    """(feature, id, problem) of cases that break a rule: repeated ids in a file, missing parts of their feature."""
    n = F.count("*").over(Window.partitionBy("file", "id"))
    missing = (
        F.when((F.col("feature") == "dedup") & (F.col("query").isNull() | F.col("items").isNull()), "no query or items")
        .when((F.col("feature") == "merge") & (F.col("head").isNull() | F.col("tail").isNull()), "no head or tail")
        .when((F.col("feature") == "title") & F.col("message").isNull(), "no message")
        .when((F.col("feature") == "classify") & (F.coalesce(F.size("messages"), F.lit(0)) < 1), "no messages")
    )
    return cases.where("NOT bad").withColumn("problem", F.when(n > 1, "repeated id").otherwise(missing)).where("problem IS NOT NULL").select("feature", "id", "problem")


def export_csv(items: DataFrame, path: str) -> None:
    """Cards as CSV whose cells no spreadsheet takes for formulas."""
    flat = [c for c, t in items.dtypes if not t.startswith(("array", "struct", "map"))]
    items.select(*[csv_cell(F.col(c)).alias(c) for c in flat]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_daily(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows to a log partitioned by day."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def retained(log: DataFrame, today: Column, days: int) -> DataFrame:
    """The part of a daily log within its retention."""
    return log.where(F.col("day") > F.date_sub(today, days))


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version of a table beside the old ones; readers switch by the path they are given."""
    path = f"{root}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def valid_snapshot(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A snapshot with the expected columns and types that is not empty; otherwise ValueError."""
    df = spark.read.parquet(path)
    want = spark.createDataFrame([], ddl).dtypes
    if df.dtypes != want:
        raise ValueError(f"schema differs: {sorted(set(df.dtypes) ^ set(want))}")
    if df.isEmpty():
        raise ValueError("the snapshot is empty")
    return df


def load_vectors(store: DataFrame, model: str) -> DataFrame:
    """The newest vector of each card for a model."""
    own = store.where(F.col("model") == model)
    return own.groupBy("item_id").agg(F.max_by("embedding", "created_at").alias("embedding"), F.max("created_at").alias("created_at"))


def parse_vectors(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(good rows with the vector parsed, rows whose JSON is not a vector)."""
    from larkspur.functions.jsonx import vector

    parsed = rows.withColumn("vec", vector(F.col(column)))
    return parsed.where("vec IS NOT NULL"), parsed.where("vec IS NULL").drop("vec")
