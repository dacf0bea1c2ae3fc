"""JSON text from outside: strict where it can be, empty where it is not JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.json_repair import repair
from larkspur.functions.times import TIME_POINTS, clean_time


def string_set(c: Column) -> Column:
    """A JSON list of texts as a sorted set; anything else gives the empty set."""
    return F.array_sort(F.array_distinct(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))))


def time_points(c: Column, most: int = 20, label: int = 40) -> Column:
    """A JSON list of time points: valid types and times only, each (type, time) once, at most `most`."""
    raw = F.coalesce(F.from_json(c, TIME_POINTS), F.array().cast(TIME_POINTS))
    clean = F.transform(raw, lambda p: F.struct(p["type"].alias("type"), clean_time(p["time"]).alias("time"), F.substring(F.coalesce(p["label"], F.lit("")), 1, label).alias("label")))
    valid = F.filter(clean, lambda p: p["type"].isin("start", "end") & (p["time"] != ""))
    keys = F.transform(valid, lambda p: F.concat_ws("|", p["type"], p["time"]))
    once = F.filter(F.zip_with(valid, F.sequence(F.lit(1), F.size(valid)), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.array_position(keys, F.concat_ws("|", x["p"]["type"], x["p"]["time"])) == x["i"])
    found = F.slice(F.transform(once, lambda x: x["p"]), 1, most)
    return F.when(F.size(valid) == 0, F.array().cast(TIME_POINTS)).otherwise(found)


def vector(c: Column) -> Column:
    """A JSON list of numbers as a vector; null where it is not one, or where an element is missing."""
    v = F.from_json(c, "array<float>")
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v)


def json_root(text: str | None) -> str | None:
    """The outermost object or list of a text, past prose and code fences; null where none parses."""
    if not text:
        return None
    for candidate in (text, re.sub(r"^```\w*\n?|\n?```$", "", text.strip())):
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            pass
    opens = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not opens:
        return None
    first = min(opens)
    last = text.rfind("}" if text[first] == "{" else "]")
    try:
        json.loads(text[first : last + 1])
        return text[first : last + 1]
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def lenient_json(s: pd.Series) -> pd.Series:
    """JSON text that parses, cut out of a model's answer; null otherwise."""
    return s.map(json_root, na_action=None)


def _repaired(text: str | None, cut: bool) -> str | None:
    root = json_root(text)
    if root is not None or cut or not text:
        return root
    try:
        return json.dumps(repair(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def repaired_json(s: pd.Series, cut: pd.Series) -> pd.Series:
    """As `lenient_json`; where nothing parses, what a tolerant reader makes of the answer. An answer that was cut off at its length
    is not repaired: its last value would be half a value."""
    return pd.Series([_repaired(x, bool(c)) for x, c in zip(s, cut, strict=True)], dtype=object)


def parse_verdict(answer: Column, key: str = "same") -> Column:
    """A judge's answer: true, false or null (unknown)."""
    value = F.lower(F.trim(F.get_json_object(lenient_json(answer), f"$.{key}")))
    return F.when(value.isin("true", "1", "yes"), True).when(value.isin("false", "0", "no"), False)


def parse_title(answer: Column, most: int = 50) -> Column:
    """A model's title: its JSON field or its first line, clipped; null where empty."""
    first = F.trim(F.coalesce(F.get_json_object(lenient_json(answer), "$.title"), F.element_at(F.split(answer, "\n"), 1)))
    return F.nullif(F.substring(first, 1, most), F.lit(""))


def citations(answer: Column, evidence: Column) -> Column:
    """The distinct [n] marks of an answer that point at existing evidence, in order of appearance."""
    n = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(n, lambda i: (i >= 1) & (i <= evidence)))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column) -> Column:
    """The text of a JSON string; null for any other value."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _entries(answer: Column, task: str | None = None) -> Column:
    """The elements of a model's list, bare or under `data`; null where there is none or it names another task."""
    root = F.try_parse_json(lenient_json(answer))
    listed = F.when(_kind(root).startswith("ARRAY"), root).otherwise(_field(root, "data"))
    ours = F.coalesce(_string(_field(root, "task")) == task, F.lit(True)) if task else F.lit(True)
    return F.when(ours & _kind(listed).startswith("ARRAY"), F.try_variant_get(listed, "$", "array<variant>"))


def _index(v: Column) -> Column:
    """The whole number under `index`; null for anything else, numbers in quotes too."""
    i = _field(v, "index")
    return F.when(_kind(i) == "BIGINT", F.try_variant_get(i, "$", "long"))


def _by_index(found: Column) -> Column:
    """A map by index; of entries with one index the last stands."""
    put = lambda acc, x: F.concat(F.filter(acc, lambda y: y["index"] != x["index"]), F.array(x))
    # A list of one row, so that found is computed one time: it parses the whole answer.
    return F.transform(F.array(found), lambda all_: F.map_from_entries(F.aggregate(all_, F.slice(all_, 1, 0), put)))[0]


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def parse_summaries(answer: Column) -> Column:
    """A summary answer as map<index, (summary, subject)>: entries with at least one of both; empty where none can be read."""
    made = F.transform(
        F.coalesce(_entries(answer), F.array().cast("array<variant>")),
        lambda v: F.struct(_index(v).alias("index"), F.struct(_one_line(_string(_field(v, "summary"))).alias("summary"), F.trim(F.coalesce(_string(_field(v, "subject")), F.lit(""))).alias("subject")).alias("value")),
    )
    return _by_index(F.filter(made, lambda x: x["index"].isNotNull() & ((x["value"]["summary"] != "") | (x["value"]["subject"] != ""))))


def parse_times(answer: Column, label: int = 40) -> Column:
    """A time answer as map<index, time points>; null where it cannot be read, empty where it holds none.

    Points with another type or no real time are dropped alone, entries without an index or a list too.
    """

    def point(v: Column) -> Column:
        name = F.substring(_one_line(F.try_variant_get(_field(v, "label"), "$", "string")), 1, label)
        return F.struct(_string(_field(v, "type")).alias("type"), clean_time(_string(_field(v, "time"))).alias("time"), name.alias("label"))

    def entry(v: Column) -> Column:
        raw = _field(v, "times")
        points = F.transform(F.when(_kind(raw).startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>")), point)
        return F.struct(_index(v).alias("index"), F.filter(points, lambda p: p["type"].isin("start", "end") & (p["time"] != "")).alias("value"))

    return _by_index(F.filter(F.transform(_entries(answer, "times"), entry), lambda x: x["index"].isNotNull() & x["value"].isNotNull()))


def citation_index(v: Column) -> Column:
    """A citation's number from a whole number, a float without fraction or digits in quotes; null for anything else."""
    kind, text = _kind(v), F.trim(_string(v))
    number = F.try_variant_get(v, "$", "double")
    whole = (kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & (number == F.floor(number))
    return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "long")).when(whole, number.cast("long")).when(text.rlike(r"^\d+$"), text.try_cast("long"))


def cited_answer(content: Column, evidence: Column) -> Column:
    """struct(answer, citations, refused) of a model's answer over `evidence` numbered passages.

    A JSON answer with a list of citations cites these alone, none if the list is empty; otherwise the [n] marks of the text
    count, and without any all passages. An empty JSON answer is refused.
    """
    root = F.try_parse_json(lenient_json(content))
    said = F.trim(_string(_field(root, "answer")))
    listed = _field(root, "citations")
    explicit = said.isNotNull() & _kind(listed).startswith("ARRAY")
    given = F.transform(F.try_variant_get(listed, "$", "array<variant>"), citation_index)
    known = F.array_sort(F.array_distinct(F.filter(given, lambda n: (n >= 1) & (n <= evidence))))
    marks = F.array_sort(citations(content, evidence)).cast("array<bigint>")
    every = F.when(evidence > 0, F.sequence(F.lit(1).cast("bigint"), evidence.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    refused = F.coalesce(said == "", F.lit(False))
    cited = F.when(refused, F.array().cast("array<bigint>")).when(explicit, known).when(F.size(marks) > 0, marks).otherwise(every)
    return F.struct(F.coalesce(said, content).alias("answer"), cited.alias("citations"), refused.alias("refused"))
