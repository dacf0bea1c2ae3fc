"""Upstream rows to canonical messages: one select per source shape, prefilters as predicates, article cards exploded."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import clean_display_name, mask_pii, media_path

#: What attachment placeholders begin with.
ATTACHMENTS = ("图片", "语音", "视频", "文件", "表情", "位置", "名片", "链接", "红包", "转账", "image", "voice", "video", "file")
MIN_CHARS = 5


def _named(df: DataFrame, *names: str) -> Column:
    """The first of several columns that is there and not blank."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def canonical(rows: DataFrame, source: str) -> DataFrame:
    """History or event rows of any of the sources as messages; personal data is masked on the way in."""
    sender = _named(rows, "sender_name", "senderName", "display_name", "nickname", "sender_id", "senderUsername", "sender", "from", "user_id")
    stamp = _named(rows, "timestamp", "createTime", "create_time", "time")
    media = _named(rows, "media_url", "mediaUrl", "image_url")
    return rows.select(
        F.lit(source).alias("source"), _named(rows, "msg_id", "rawid", "messageId", "message_id", "id").alias("msg_id"),
        _named(rows, "session_id", "sessionId", "talker", "group_id").alias("session_id"), clean_display_name(_named(rows, "group_name", "sessionName", "session_name")).alias("group_name"),
        _named(rows, "sender_id", "senderUsername", "sender", "from", "user_id").alias("sender_id"), clean_display_name(sender).alias("sender_name"),
        mask_pii(_named(rows, "content", "text", "raw_message")).alias("content"), F.coalesce(stamp.try_cast("long"), F.lit(0)).alias("timestamp"),
        _named(rows, "is_self", "isSend", "isSelf").isin("1", "true").alias("is_self"),
        F.when(media != "", F.array(F.coalesce(media_path(media), media))).otherwise(F.array().cast("array<string>")).alias("image_urls"), _named(rows, "article_url", "url").alias("article_url"),
    )


def wanted(messages: DataFrame) -> DataFrame:
    """Without blanks, short texts, attachment placeholders without media, bare user ids and remains of rich-media XML."""
    text = F.trim("content")
    has_media = F.size("image_urls") > 0
    attachment = text.rlike(r"^\[(?:" + "|".join(ATTACHMENTS) + r")\]")
    bare_id = text.rlike(r"^(?:wxid_[A-Za-z0-9_]+|[A-Za-z0-9_]+@chatroom)$")
    xml = text.rlike(r"^<\?xml|^<msg\b|^<appmsg\b|^<sysmsg\b")
    return messages.where((has_media & attachment) | (~attachment & (F.length(text) >= MIN_CHARS) & ~bare_id & ~xml))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def article_items(xml: Column) -> Column:
    """array<struct<title,summary,url>> of an article card: its items that have a title (or a second form of it), or the
    outer card where no item has one. Text that is no article card gives none."""
    xml = F.coalesce(xml, F.lit(""))

    def field(part: Column, tag: str) -> Column:
        inner = F.regexp_extract(part, rf"(?s)<{tag}>\s*(?:<!\[CDATA\[.*?\]\]>|.*?)\s*</{tag}>", 0)
        bare = F.regexp_replace(inner, rf"(?s)^<{tag}>\s*|\s*</{tag}>$", "")
        return F.trim(F.regexp_replace(bare, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))

    card = lambda part, title, summary: F.struct(title.alias("title"), field(part, summary).alias("summary"), field(part, "url").alias("url"))
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    many = F.filter(F.transform(parts, lambda p: card(p, F.coalesce(F.nullif(field(p, "title"), F.lit("")), field(p, "title_v2")), "summary")), lambda a: a["title"] != "")
    head = F.substring_index(xml, "<mmreader", 1)
    one = F.filter(F.array(card(head, field(head, "title"), "des")), lambda a: a["title"] != "")
    is_card = F.ltrim(xml).startswith("<msg") & F.contains(xml, F.lit("<appmsg"))
    return F.when(is_card, F.when(F.size(many) > 0, many).otherwise(one)).otherwise(F.array().cast("array<struct<title:string,summary:string,url:string>>"))


def explode_articles(messages: DataFrame, xml_col: str = "raw_xml") -> DataFrame:
    """A message per article of a card, numbered from 1 after its message, with labelled title and summary; other messages
    stay."""
    rows = messages.withColumn("a__", article_items(F.col(xml_col)))
    plain = rows.where("size(a__) = 0").drop("a__")
    each = rows.where("size(a__) > 0").select("*", F.posexplode("a__").alias("i__", "x__"))
    summary = F.when(F.col("x__.summary") != "", F.concat(F.lit("摘要："), unescape("x__.summary")))
    text = F.concat_ws("\n", F.concat(F.lit("标题："), unescape("x__.title")), summary)
    each = each.withColumns({"content": mask_pii(text), "article_url": unescape("x__.url"), "msg_id": F.concat_ws("_", "msg_id", F.col("i__") + 1)})
    return plain.unionByName(each.drop("a__", "i__", "x__"))
