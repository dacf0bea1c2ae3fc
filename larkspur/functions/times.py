"""Times are naive local strings or epoch seconds; the session's time zone is the zone."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINTS = T.ArrayType(T.StructType().add("type", T.StringType()).add("time", T.StringType()).add("label", T.StringType()))
_HINTS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("text", T.StringType()).add("position", T.IntegerType()).add("pattern_id", T.IntegerType()).add("clock", T.BooleanType()))
TIME_POINTS = "array<struct<type:string,time:string,label:string>>"
_STORED = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2})?$"


def local_minute(epoch: Column) -> Column:
    """Epoch seconds as a local minute; null and 0 give null."""
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"))


def stored_time(c: Column) -> Column:
    """A stored date or minute as a timestamp; anything else gives null."""
    t = F.replace(F.trim(c), F.lit("T"), F.lit(" "))
    full = F.when(F.length(t) == 10, F.concat(t, F.lit(" 00:00"))).otherwise(t)
    return F.when(F.trim(c).rlike(_STORED), F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm")))


def clean_time(c: Column) -> Column:
    """A real calendar date or minute in canonical form, else the empty text."""
    t = F.trim(F.coalesce(c, F.lit("")))
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2})?$") & stored_time(t).isNotNull()
    return F.when(ok, t).otherwise(F.lit(""))


def is_past(c: Column, now: Column) -> Column:
    """Whether a stored time is over; a date lasts through its day; not a time: false."""
    t = stored_time(c)
    past = F.when(F.length(F.trim(c)) == 10, F.to_date(t) < F.to_date(now)).otherwise(t < now)
    return F.coalesce(past, F.lit(False))


def is_ahead(c: Column, now: Column) -> Column:
    return stored_time(c).isNotNull() & ~is_past(c, now)


def item_is_expired(start: Column, end: Column, extra: Column, now: Column) -> Column:
    """The end is over and no start, end or extra point is still ahead. extra: array of time points."""
    points = F.filter(F.coalesce(extra, F.array().cast(TIME_POINTS)), lambda p: p["type"].isin("start", "end"))
    ahead = is_ahead(start, now) | is_ahead(end, now) | F.exists(points, lambda p: is_ahead(p["time"], now))
    return is_past(end, now) & ~F.coalesce(ahead, F.lit(False))


def register_expiry(spark: SparkSession, name: str = "item_is_expired") -> None:
    """The expiry rule as a SQL function of (start, end, extra time points, now), itself SQL, so Catalyst inlines it."""
    day = "trim({0}) rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'"
    at = "try_to_timestamp(CASE WHEN trim({0}) rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN concat(trim({0}), ' 00:00') WHEN trim({0}) rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}$' THEN replace(trim({0}), 'T', ' ') END, 'yyyy-MM-dd HH:mm')"
    over = f"coalesce(CASE WHEN {day} THEN to_date({at}) < to_date(now) ELSE {at} < now END, false)"
    ahead = f"({at} IS NOT NULL AND NOT {over})"
    points = f"coalesce(exists(extra, p -> p.type IN ('start', 'end') AND {ahead.format('p.time')}), false)"
    rule = f"{over.format('until')} AND NOT ({ahead.format('since')} OR {ahead.format('until')} OR {points})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(since STRING, until STRING, extra {TIME_POINTS}, now TIMESTAMP) RETURNS BOOLEAN RETURN {rule}")


def coerce_epoch(c: Column) -> Column:
    """Epoch seconds from digits or one of three local formats; anything else is null (see `bad_time`)."""
    s = F.trim(c.cast("string"))
    stamps = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]
    return F.coalesce(F.when(s.rlike(r"^-?\d+$"), s.try_cast("long")), *[F.unix_timestamp(x) for x in stamps])


def bad_time(c: Column) -> Column:
    """Whether a given time cannot be read: the row is an error, not a message of the year 1970."""
    return c.isNotNull() & coerce_epoch(c).isNull()


def is_echo(time: Column, sent: Column) -> Column:
    """Whether an expected time only repeats when the message was sent, at its own precision."""
    same = F.when(F.length(time) == 10, F.substring(local_minute(sent), 1, 10) == time).otherwise(local_minute(sent) == time)
    return F.coalesce(same, F.lit(False))


def reminder_minute(c: Column) -> Column:
    """A reminder input, with or without a zone, as a local minute; not a time: null."""
    zoned = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSS]XXX"))
    return F.date_format(F.coalesce(zoned, F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm[:ss]"))), "yyyy-MM-dd HH:mm")


def time_badge(start: Column, end: Column, extra: Column, now: Column, soon_days: int = 3) -> Column:
    """The end decides where there is one: expired (partial if another point is ahead), urgent within its day or 24 hours,
    soon within `soon_days`, else later. Otherwise the start: started, today or later. Null without both."""
    date_only = lambda c: F.length(F.trim(c)) == 10
    due, begin = stored_time(end), stored_time(start)
    points = F.concat(F.array(start, end), F.transform(F.coalesce(extra, F.array().cast(TIME_POINTS)), lambda p: p["time"]))
    left = F.unix_timestamp(due) - F.unix_timestamp(now)
    of_end = (
        F.when(is_past(end, now), F.when(F.exists(points, lambda t: is_ahead(t, now)), "partial").otherwise("expired"))
        .when(date_only(end), F.when(F.to_date(due) == F.to_date(now), "urgent").when(left <= soon_days * 86400, "soon").otherwise("later"))
        .when(left < 86400, "urgent")
        .when(left < soon_days * 86400, "soon")
        .otherwise("later")
    )
    of_start = F.when(is_past(start, now), "started").when(F.to_date(begin) == F.to_date(now), "today").otherwise("later")
    return F.when(due.isNotNull(), of_end).when(begin.isNotNull(), of_start)


def backoff_seconds(step: Column, first: int = 60, most: int = 600) -> Column:
    return F.least(first * F.pow(F.lit(2.0), step), F.lit(float(most)))


# Chinese time expressions.
_ABSOLUTE = re.compile(r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})[日号]?")
_MONTH_DAY = re.compile(r"(\d{1,2})月(\d{1,2})[日号]")
_WEEKDAY = re.compile(r"(下|本|这)?周([一二三四五六日天])")
_DAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
_STRONG = [
    re.compile(p)
    for p in (
        r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?",
        r"\d{1,2}月\d{1,2}[日号]",
        r"(下|本|这)?周[一二三四五六日天]",
        r"(明天|后天|今天|今晚|明晚|大后天)",
        r"(上午|下午|晚上|中午|清晨|凌晨)\d{1,2}[点时](\d{1,2})?分?",
        r"\d{1,2}[:点时]\d{2}分?",
        r"(截止|截止到|截至| deadline|Deadline)",
    )
]
_CLOCKS = (4, 5)
_WEAK = re.compile(r"(?<![\d./-])\d{1,2}[./]\d{1,2}(?![\d./-])")
_VAGUE = re.compile(r"(尽早|尽快|近期|最近|随时)")


def _date(y: int, m: int, d: int) -> dt.date | None:
    try:
        return dt.date(y, m, d)
    except ValueError:
        return None


def dates_in(text: str | None, anchor: dt.date | None) -> list[str]:
    """Dates that a text names, relative ones from the anchor: absolute, month and day, then weekdays."""
    if not text:
        return []
    found: dict[str, None] = {}
    used = []
    for m in _ABSOLUTE.finditer(text):
        used.append(m.span())
        if d := _date(*map(int, m.groups())):
            found[d.isoformat()] = None
    if anchor:
        for m in _MONTH_DAY.finditer(text):
            if any(a < m.end() and m.start() < b for a, b in used):
                continue
            near = [d for y in (-1, 0, 1) if (d := _date(anchor.year + y, int(m[1]), int(m[2])))]
            if near:
                found[min(near, key=lambda d: abs((d - anchor).days)).isoformat()] = None
        monday = anchor - dt.timedelta(anchor.weekday())
        for m in _WEEKDAY.finditer(text):
            found[(monday + dt.timedelta(_DAYS[m[2]] + 7 * (m[1] == "下"))).isoformat()] = None
    return list(found)


@F.pandas_udf(_POINTS)
def parse_dates(text: pd.Series, anchor: pd.Series) -> pd.Series:
    """text and the anchor's local date (null or empty: no anchor) -> time points."""
    day = lambda a: dt.date.fromisoformat(str(a)[:10]) if isinstance(a, str) and a else None
    return pd.Series([[{"type": "start", "time": t, "label": ""} for t in dates_in(x, day(a))] for x, a in zip(text, anchor, strict=True)])


def hints_in(text: str | None) -> list[dict]:
    """Spans that hint at a time: strong patterns in order without overlaps, then weak numbers."""
    if not text or _VAGUE.search(text) and not any(p.search(text) for p in _STRONG):
        return []
    spans: list[tuple[int, int, int]] = []
    for i, pattern in [*enumerate(_STRONG), (-1, _WEAK)]:
        taken = list(spans) if i < 0 else spans
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, k in taken if k >= 0):
                spans.append((*m.span(), i))
    return [{"kind": "strong" if k >= 0 else "weak", "text": text[a:b][:32], "position": a, "pattern_id": k, "clock": k in _CLOCKS} for a, b, k in sorted(spans)]


@F.pandas_udf(_HINTS)
def time_hints(text: pd.Series) -> pd.Series:
    return pd.Series([hints_in(x) for x in text])


def hint_resolved(hint_text: Column, clock: Column, times: Column) -> Column:
    """Whether some found time has exactly the numbers of a hint (hours may differ by twelve)."""
    n = F.transform(F.regexp_extract_all(hint_text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))

    def by_date(t: Column) -> Column:
        d = F.transform(F.split(F.substring(t, 1, 10), "-"), lambda x: x.cast("int"))
        return ((F.size(n) == 2) & (n == F.slice(d, 2, 2))) | ((F.size(n) == 3) & (n == d))

    def by_clock(t: Column) -> Column:
        c = F.transform(F.split(F.substring(t, 12, 5), ":"), lambda x: x.try_cast("int"))
        first, hour = F.get(n, F.lit(0)), F.get(c, F.lit(0))
        same = (first == hour) | ((first <= 12) & (first + 12 == hour))
        return (F.length(t) > 10) & same & ((F.size(n) == 1) | ((F.size(n) == 2) & (F.get(n, F.lit(1)) == F.get(c, F.lit(1)))))

    return F.exists(times, lambda t: F.coalesce(F.when(clock, by_clock(t)).otherwise(by_date(t)), F.lit(False)))
