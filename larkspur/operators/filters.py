"""Filters and predicates over messages and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import contains_folded, find_all_terms, is_placeholder_only
from larkspur.functions.times import item_is_expired

SEARCHED = ("title", "source_quote", "source_group", "sender_name", "category", "key_info", "subject")
VERIFIED = {"memo": 1, "ignored": -1}


def entry_reason(messages: DataFrame, sessions: DataFrame, processed: DataFrame, ocr: bool = False) -> DataFrame:
    """messages with `reason`: why the entry filter drops a row, or null; the first reason in order wins."""
    on = sessions.where("enabled = 1").select("source", "session_id").distinct().withColumn("enabled__", F.lit(True))
    seen = processed.select("source", "msg_id").distinct().withColumn("seen__", F.lit(True))
    rows = messages.join(on, ["source", "session_id"], "left").join(seen, ["source", "msg_id"], "left")
    lone_image = is_placeholder_only(F.col("content")) & F.lit(not ocr)
    if "image_urls" in messages.columns:
        lone_image = lone_image & (F.size("image_urls") > 0)
    reason = F.when(F.col("is_self"), "self").when(lone_image, "image").when(F.col("enabled__").isNull(), "session").when(F.col("seen__").isNotNull(), "processed")
    return rows.withColumn("reason", reason).drop("enabled__", "seen__")


def entry_filter(messages: DataFrame, sessions: DataFrame, processed: DataFrame, ocr: bool = False) -> DataFrame:
    return entry_reason(messages, sessions, processed, ocr).where("reason IS NULL").drop("reason")


def entry_counters(messages: DataFrame, sessions: DataFrame, processed: DataFrame, ocr: bool = False) -> DataFrame:
    return entry_reason(messages, sessions, processed, ocr).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def is_category(category: str | None) -> Column:
    return F.lit(True) if category in (None, "", "全部") else F.col("category") == category


def verified_is(state: str) -> Column:
    """memo, ignored, all; anything else: the cards still open."""
    return F.lit(True) if state == "all" else F.col("is_verified") == VERIFIED.get(state, 0)


def matches_search(q: str | None, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Any word of q is a literal part of any searched column; a blank q filters nothing."""
    terms = (q or "").split()
    found = F.lit(not terms)
    for term in terms:
        for c in columns:
            found = found | contains_folded(F.col(c), term)
    return found


def in_group(source_group: str | None) -> Column:
    return contains_folded(F.col("source_group"), source_group) if source_group else F.lit(True)


def expired(now: str) -> Column:
    return item_is_expired(F.col("start"), F.col("end"), F.col("extra_times"), F.lit(now).cast("timestamp"))


def shown(items: DataFrame, categories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cards whose category and session are not switched off; cards without a row for either stay."""
    off = categories.where("enabled = 0").select(F.col("name").alias("category")).distinct()
    mute = sessions.where("enabled = 0").select("source", "session_id").distinct()
    return items.join(off, "category", "left_anti").join(mute, ["source", "session_id"], "left_anti")


def item_list(items: DataFrame, categories: DataFrame, sessions: DataFrame, category: str | None = None, verified: str = "", q: str | None = None, source_group: str | None = None, min_msg_time: int | None = None, hide_expired: bool = False, now: str | None = None) -> DataFrame:
    """The cards of a list view: every clause of the list's filter."""
    if hide_expired and now is None:
        raise ValueError("hide_expired needs now")
    rows = items.where(is_category(category) & verified_is(verified) & matches_search(q) & in_group(source_group))
    if min_msg_time is not None:
        rows = rows.where(F.col("msg_time") >= min_msg_time)
    rows = shown(rows, categories, sessions)
    return rows.where(~expired(now)) if hide_expired else rows


def due_reminders(items: DataFrame, now: str) -> DataFrame:
    """Reminders up to now on cards that are not ignored, earliest first; times compare as text."""
    return items.where(F.col("remind_at").isNotNull() & (F.col("remind_at") != "") & (F.col("remind_at") <= now) & (F.col("is_verified") >= 0)).orderBy("remind_at", "id")


def subject_timeline(items: DataFrame, subject: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Cards of a normalised subject that are not ignored, newest first."""
    rows = items.where((F.col("subject") == subject) & (F.col("is_verified") >= 0)).orderBy(F.desc("msg_time"), F.desc("id"))
    return rows.offset(offset).limit(limit) if limit is not None else rows


def calendar_range(items: DataFrame, date_from: str, date_to: str, most: int = 1000) -> DataFrame:
    """Cards with a start, an end or any extra point in [from, to), not ignored, by time; at most `most` of them."""
    inside = lambda c: F.coalesce((c >= date_from) & (c < date_to), F.lit(False))
    hit = inside(F.col("start")) | inside(F.col("end")) | F.exists(F.coalesce("extra_times", F.array().cast("array<struct<type:string,time:string,label:string>>")), lambda p: inside(p["time"]))
    return items.where((F.col("is_verified") >= 0) & hit).orderBy(F.coalesce("start", "end"), "id").limit(most)


def indexable(content: Column) -> Column:
    """Text worth indexing: not blank and more than placeholders."""
    return (F.trim(F.coalesce(content, F.lit(""))) != "") & ~is_placeholder_only(content)


def in_scope(rows: DataFrame, sessions: DataFrame, groups_only: bool = True, session_id: str | None = None) -> DataFrame:
    """Rows of enabled sessions, optionally of groups only or of one session."""
    on = sessions.where("enabled = 1")
    on = on.where("is_group = 1") if groups_only else on
    on = on.where(F.col("session_id") == session_id) if session_id else on
    return rows.join(on.select("source", "session_id"), ["source", "session_id"], "left_semi")


def keyword_match(items: DataFrame, lists: DataFrame, fields: tuple[str, ...] = ("title", "source_quote", "key_info")) -> DataFrame:
    """items with `hit`: whether any enabled entry of lists (entry, enabled) has a word in the card.

    The enabled words are one array, a dimension that a person types; it is joined as a single row.
    """
    words = lists.where("enabled").select(F.explode(F.split(F.trim("entry"), r"\s+")).alias("w")).where("w <> ''").agg(F.collect_set("w").alias("words__"))
    return items.crossJoin(words).withColumn("hit", find_all_terms(F.col("words__"), F.concat_ws("\n", *fields))).drop("words__")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def existing_ids(ids: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().join(items.select(key), key, "left_semi")


def verified_flags(ids: DataFrame, items: DataFrame) -> DataFrame:
    """id, is_verified for every asked id; unknown ids count as open."""
    return ids.select("id").distinct().join(items.select("id", "is_verified"), "id", "left").withColumn("is_verified", F.coalesce("is_verified", F.lit(0)))


def skipped(batch: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """Keys of a batch that were neither selected nor failed: they are marked processed."""
    key = ["source", "msg_id"]
    return batch.select(*key).join(selected.select(*key), key, "left_anti").join(failed.select(*key), key, "left_anti")


def acceptance_cases(cases: DataFrame) -> DataFrame:
    return cases.where("origin = 'manual'")


def noise_cards(items: DataFrame) -> DataFrame:
    return items.where("is_verified = -1")


def categorized(items: DataFrame) -> DataFrame:
    return items.where("is_verified <> -1 AND coalesce(trim(category), '') <> ''")


def sessions_view(sessions: DataFrame, kind: str | None = None, source: str | None = None, active_since: int | None = None) -> DataFrame:
    """Sessions by kind (group, private, official), source and last activity."""
    kinds = {"group": F.col("is_group") == 1, "official": F.col("is_official") == 1, "private": (F.col("is_group") == 0) & (F.col("is_official") == 0)}
    rows = sessions.where(kinds[kind]) if kind else sessions
    rows = rows.where(F.col("source") == source) if source else rows
    return rows.where(F.col("last_active") >= active_since) if active_since is not None else rows


def card_of_message(messages: DataFrame) -> DataFrame:
    """Card columns of classified messages (with category, title, key_info, subject, start, end, extra_times)."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.substring("content", 1, 50))
    return messages.select(
        F.substring(F.sha2(F.concat_ws("\x00", "source", "msg_id"), 256), 1, 32).alias("id"),
        "category", title.alias("title"), "key_info", "sender_name", F.col("content").alias("source_quote"), F.col("group_name").alias("source_group"),
        "subject", "source", F.col("msg_id").alias("source_msg_id"), "session_id", F.col("timestamp").alias("msg_time"), F.lit(0).alias("is_verified"),
        F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), "image_urls", "article_url", "start", "end", "extra_times",
    )
