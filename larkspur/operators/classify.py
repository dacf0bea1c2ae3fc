"""Classification of message batches by a model: answers read strictly, gaps and unknown names asked again, long answers halved.

A batch is what one prompt holds (its size is checked where it is cut), so a request is a small row. Requests go in rounds of
whole tables: those whose answer was cut off at its length come back as two halves in the next round, until none is left, a
request has one message, or the depth is reached. Messages without a usable answer are then collected and asked once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import jsonx
from larkspur.ports.ai import ProviderFactory, ask
from larkspur.scratch import written

MAX_DEPTH = 6
_REQUEST = ["batch_id", "part"]
AGAIN = "again"


def request_prompt(categories: list[str], rows: str = "messages"):
    """The categories, then a line for each message: [number] text."""
    lines = F.transform(rows, lambda m: F.concat(F.lit("["), m["idx"].cast("string"), F.lit("] "), F.regexp_replace(F.coalesce(m["content"], F.lit("")), r"\s+", " ")))
    return F.concat(F.col("part"), F.lit("\n"), F.lit("|".join(categories)), F.lit("\n"), F.array_join(lines, "\n"))


def read_answers(answers: DataFrame, categories: list[str]) -> DataFrame:
    """A row a message of answers (batch_id, part, count, answer): idx, status (include, exclude, retry, failed), reason, category, key_info,
    quote, time.

    The whole request fails where the answer is no list of objects, or a number is missing, beyond the request or there twice.
    Alone fail entries with an unknown category and numbers that do not come up: they are to be asked again.
    """
    root = F.try_parse_json(jsonx.repaired_json("answer", F.lit(False)))
    listed = F.when(jsonx._kind(root).startswith("ARRAY"), root).otherwise(jsonx._field(root, "data"))
    entries = F.when(jsonx._kind(listed).startswith("ARRAY"), F.try_variant_get(listed, "$", "array<variant>"))
    told = lambda v, name: F.trim(F.try_variant_get(jsonx._field(v, name), "$", "string"))

    def entry(v):
        key = jsonx._field(v, "key")
        words = F.filter(F.try_variant_get(key, "$", "array<string>"), lambda k: F.trim(k) != "")
        return F.struct(
            jsonx._index(v).cast("int").alias("idx"),
            F.coalesce(told(v, "include").isin("false", "False", "0"), F.lit(False)).alias("out"),
            jsonx._string(jsonx._field(v, "category")).alias("category"),
            F.coalesce(F.when(jsonx._kind(key).startswith("ARRAY"), F.array_join(words, ", ")), F.trim(jsonx._string(key)), F.lit("")).alias("key_info"),
            F.coalesce(told(v, "quote"), F.lit("")).alias("quote"),
            F.coalesce(told(v, "time").isin("true", "True", "1"), F.lit(False)).alias("time"),
        )

    rows = answers.withColumn("found", F.transform(entries, entry))
    indexes = F.transform("found", lambda e: e["idx"])
    whole = F.coalesce(F.forall("found", lambda e: e["idx"].between(0, F.col("count") - 1)) & (F.size(F.array_distinct(indexes)) == F.size("found")), F.lit(False))
    blank = lambda i, status, reason: F.struct(i.cast("int").alias("idx"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("category"), F.lit("").alias("key_info"), F.lit("").alias("quote"), F.lit(False).alias("time"))
    every = F.sequence(F.lit(0), F.col("count") - 1)
    known = lambda e: F.coalesce(e["category"].isin(categories), F.lit(False))

    def ruled(e):
        status = F.when(e["out"], "exclude").when(known(e), "include").otherwise("retry")
        kept = lambda c, other: F.when(~e["out"] & known(e), c).otherwise(other)
        return F.struct(e["idx"].alias("idx"), status.alias("status"), F.when(~e["out"] & ~known(e), "unknown category").alias("reason"), kept(e["category"], F.lit(None)).alias("category"), kept(e["key_info"], F.lit("")).alias("key_info"), kept(e["quote"], F.lit("")).alias("quote"), kept(e["time"], F.lit(False)).alias("time"))

    missing = F.transform(F.array_except(every, indexes), lambda i: blank(i, "retry", "missing"))
    told_rows = F.when(whole, F.concat(F.transform("found", ruled), missing)).otherwise(F.transform(every, lambda i: blank(i, "failed", "unreadable")))
    return rows.select(*_REQUEST, F.explode(told_rows).alias("m")).select(*_REQUEST, "m.*")


def _requests(members: DataFrame) -> DataFrame:
    """A row a request of members (batch_id, part, seq, content): messages numbered from 0 in the order of seq, count."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "content")))
    rows = members.groupBy(*_REQUEST).agg(listed.alias("listed"))
    return rows.select(*_REQUEST, F.transform("listed", lambda m, i: F.struct(i.alias("idx"), m["seq"].alias("seq"), m["content"].alias("content"))).alias("messages"), F.size("listed").alias("count"))


def _asked(members: DataFrame, categories: list[str], factory: ProviderFactory, depth: int) -> DataFrame:
    """A row a member: batch_id, seq and what `read_answers` says of it."""
    open_, done = written(_requests(members), "requests"), None
    for left in range(depth, -1, -1):
        told = written(ask(open_, request_prompt(categories), factory, "answer", finish="finish"), "answers")
        cut = F.coalesce(F.col("finish") == "length", F.lit(False)) & (F.col("count") > 1) & F.lit(left > 0)
        read = told.where(~cut).withColumn("answer", F.when(F.coalesce(F.col("finish") != "length", F.lit(True)), F.col("answer")))
        found = read_answers(read, categories).join(read.select(*_REQUEST, F.explode("messages").alias("m")).select(*_REQUEST, "m.idx", "m.seq"), [*_REQUEST, "idx"])
        done = found if done is None else done.unionByName(found)
        halves = told.where(cut).select(*_REQUEST, F.explode("messages").alias("m"), F.when(F.col("m.idx") < F.floor(F.col("count") / 2), "0").otherwise("1").alias("half"))
        rest = halves.select("batch_id", F.concat("part", "half").alias("part"), F.col("m.seq").alias("seq"), F.col("m.content").alias("content"))
        if not left or rest.isEmpty():
            break
        open_ = written(_requests(rest), "requests")
    return written(done.drop("part", "idx"), "classified")


def classify_messages(messages: DataFrame, factory: ProviderFactory, categories: list[str], depth: int = MAX_DEPTH) -> DataFrame:
    """messages (batch_id, seq, content) with status (include, exclude, failed), reason, category, key_info, quote, time.

    Messages with a gap or an unknown name are asked once more, together by batch; what fails then is failed, with its reason,
    and nothing is left out: a row a message. Batches may be of any id; seq orders a batch and is there once.
    """
    members = messages.select("batch_id", F.lit("").alias("part"), "seq", "content")
    first = _asked(members, categories, factory, depth)
    again = members.join(first.where("status = 'retry'").select("batch_id", "seq"), ["batch_id", "seq"], "left_semi").withColumn("part", F.lit(AGAIN))
    second = _asked(again, categories, factory, depth)
    every = first.where("status <> 'retry'").unionByName(second)
    status = F.when(F.col("status") == "retry", "failed").otherwise(F.col("status"))
    return messages.join(every.withColumn("status", status), ["batch_id", "seq"], "left")
