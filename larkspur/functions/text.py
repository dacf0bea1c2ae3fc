"""Text functions as column expressions; pandas functions only where an order-dependent match callback is needed."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Placeholders, the patterns of personal data in order of precedence, runs of separated digits, the kinds of a
# run by its number of digits, and texts of placeholders alone.
EMAIL, PHONE, ID, CARD, TOKEN = "[EMAIL]", "[PHONE]", "[ID]", "[BANKCARD]", "[TOKEN]"
_KINDS = (
    (EMAIL, r"[A-Za-z0-9._%+\-]+[@＠][A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    (TOKEN, r"sk-[A-Za-z0-9_\-]{16,}"),
    (TOKEN, r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+"),
    (ID, r"(?<![0-9０-９])[0-9０-９]{17}[0-9０-９Xx](?![0-9０-９])"),
    (ID, r"(?<![0-9０-９])[0-9０-９]{15}(?![0-9０-９])"),
    (CARD, r"(?<![0-9０-９])[0-9０-９]{16,19}(?![0-9０-９])"),
    (PHONE, r"(?<![0-9０-９])[＋+]?(?:86|８６)?[0-9０-９]{11}(?![0-9０-９])"),
)
_RUN = re.compile(r"(?<![0-9０-９])[＋+]?[0-9０-９][0-9０-９\- －　]*[0-9０-９](?![0-9０-９])")
_BY_DIGITS = {11: PHONE, 15: ID, 16: CARD, 17: CARD, 18: CARD, 19: CARD}
COUNTRY_CODE = "86"
MAX_SEGMENTS = 5

PLACEHOLDER_ONLY = r"^(?:\s*\[[^\]]+\])+\s*$"
#: Upper and lower ASCII letters, for a fold that leaves all others alone.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_FIRST_PASS = re.compile("|".join(f"({p})" for _, p in _KINDS))
#: What every text with something to mask has: a mark of the first patterns, or ten more characters of a run after a digit.
_MAY_HOLD = r"[@＠]|sk-|eyJ|[0-9０-９][0-9０-９\- －　]{10}"
_ONLY_DIGITS = {ord(c): str(i) for i, c in enumerate("０１２３４５６７８９")} | dict.fromkeys(map(ord, "+＋- －　"))
_SEPARATORS = re.compile(r"[- －　]+")
#: A run falls apart where it is spaced, and stays together at hyphens.
_SPACED = re.compile(r"[^ －　]+")


def _placeholder(run: str) -> str:
    """What a run of separated digits is shown as: itself where it is of no kind."""
    if len(_SEPARATORS.findall(run)) >= MAX_SEGMENTS:
        return run
    digits = run.translate(_ONLY_DIGITS)
    if len(digits) == 11 + len(COUNTRY_CODE):
        digits = digits.removeprefix(COUNTRY_CODE)
    return _BY_DIGITS.get(len(digits), run)


def mask_text(text: str | None) -> str:
    """Personal data replaced by placeholders: one leftmost-first pass, then runs with separators, whole or by their spaced parts."""

    def shown(m: re.Match[str]) -> str:
        whole = _placeholder(m[0])
        return whole if whole != m[0] else _SPACED.sub(lambda part: _placeholder(part[0]), m[0])

    return _RUN.sub(shown, _FIRST_PASS.sub(lambda m: _KINDS[m.lastindex - 1][0], text)) if text else ""


@F.pandas_udf(T.StringType())
def _masked(s: pd.Series) -> pd.Series:
    return s.map(mask_text, na_action=None)


def mask_pii(c: Column) -> Column:
    """The text with personal data masked; null gives the empty text. Only texts that can hold some go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    hit = F.coalesce(c.rlike(_MAY_HOLD), F.lit(False))
    return F.when(hit, _masked(F.when(hit, c))).otherwise(F.coalesce(c, F.lit("")))


#: Characters that a Python worker turns into texts at once, so that its memory does not follow the batch.
_AT_ONCE = 1 << 20
#: White space of ASCII, as Python's \s has it, where it is not one space already.
_ASCII_SPACE = r" [\t-\r\x1c-\x20]+|[\t-\r\x1c-\x1f][\t-\r\x1c-\x20]*"


def _subject(s: str | None) -> str | None:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s)).strip().lower() if s else s


@F.arrow_udf(T.StringType())
def _subjects(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // _AT_ONCE, prepend=0, append=-1))
        parts = [batch.slice(i, j - i) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True) if j > i]
        yield pa.concat_arrays([pa.array([_subject(x) for x in part.to_pylist()], batch.type) for part in parts]) if parts else batch


def normalize_subject(c: Column | str) -> Column:
    """NFKC, white space folded, lower case; null gives the empty text. Only texts beyond ASCII go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    beyond = F.coalesce(F.length(c) < F.octet_length(c), F.lit(False))
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _ASCII_SPACE, " ")))
    return F.when(beyond, _subjects(F.when(beyond, c))).otherwise(plain)


# What a quote and a message are compared without. Control characters 1C-1F are white space there too.
_ALIGN_NOISE = r"""(?U)[\s\x1c-\x1f，。；：、,.!?！？（）()【】\[\]"'《》“”‘’「」『』]"""


def align_text(c: Column | str) -> Column:
    """A text without white space and punctuation, as quotes are compared; null gives the empty text."""
    return F.coalesce(F.regexp_replace(c, _ALIGN_NOISE, ""), F.lit(""))


def cover(q: str, c: str) -> float:
    """1 where q is part of c or empty, else the share of q that matching blocks cover."""
    if q in c:
        return 1.0
    return sum(m.size for m in difflib.SequenceMatcher(None, q, c).get_matching_blocks()) / len(q) if c else 0.0


@F.pandas_udf(T.DoubleType())
def _covers(q: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([cover(a, b) for a, b in zip(q, c, strict=True)], dtype="float64")


def containment(q: Column | str, c: Column | str) -> Column:
    """How much of q is in c; white space and punctuation do not count."""
    return _covers(align_text(q), align_text(c))


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence ratio of two titles; null where one is missing."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")


def fold_ascii(c: Column) -> Column:
    """Lower-case the 26 ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def contains_folded(c: Column, term: str) -> Column:
    """The term as a literal part of c, ASCII letters in either case."""
    return F.coalesce(F.contains(fold_ascii(c), F.lit(term.translate(str.maketrans(_UPPER, _LOWER)))), F.lit(False))


def clean_display_name(c: Column) -> Column:
    """Control characters and outer white space removed; null gives the empty text."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", ""), r"^\s+|\s+$", "")


def is_placeholder_only(c: Column) -> Column:
    return F.coalesce(c.rlike(PLACEHOLDER_ONLY), F.lit(False))


def bigrams(c: Column) -> Column:
    """Distinct character bigrams without spaces; a single character stands for itself."""
    s = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    n = F.length(s)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).otherwise(grams))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def title_overlap(a: Column, b: Column) -> Column:
    """Bigram Jaccard of two titles; where one has under two characters, that of their character sets."""
    strip = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    chars = lambda c: F.array_distinct(F.filter(F.split(strip(c), ""), lambda x: x != ""))
    short = (F.length(strip(a)) < 2) | (F.length(strip(b)) < 2)
    return F.when(short, jaccard(chars(a), chars(b))).otherwise(jaccard(bigrams(a), bigrams(b)))


def digest(c: Column, n: int = 16) -> Column:
    """The first n hex digits of the SHA-256."""
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, n)


def judge_key(title: Column, quote: Column) -> Column:
    """The key of a judged query: both texts with a NUL between them."""
    return digest(F.concat(F.coalesce(title, F.lit("")), F.lit("\x00"), F.coalesce(quote, F.lit(""))))


def embedding_text(title: Column, quote: Column, limit: int = 2000) -> Column:
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(quote, F.lit(""))), 1, limit)


def clip(c: Column, limit: int = 400) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, limit)


def split_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、]"), lambda x: F.trim(x)), lambda x: x != "")


def context_text(content: Column, quote: Column) -> Column:
    """A lone image placeholder gives way to the recognised text without its marker lines."""
    lines = F.transform(F.split(quote, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\[(?:OCR|图片 \d+ OCR 结果)\]$"))
    text = F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(quote)
    return F.when((F.coalesce(quote, F.lit("")) != "") & F.trim(content).rlike(r"^\[(?:图片|image)\]$"), text).otherwise(content)


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


#: Segments of a URL parameter's name that make it a secret, and names that are one as a whole.
SECRET_SEGMENTS = ("token", "key", "secret", "auth", "sig", "sign", "signature", "password", "passwd", "pwd", "credential")
SECRET_NAMES = ("apikey", "apikeytoken", "authorization")


def redact_query(c: Column) -> Column:
    """Values of secret parameters in a URL's query become three stars: those with a secret segment between `-` and `_`, or
    a name that ends in one when its separators are left out."""
    segment = "|".join(SECRET_SEGMENTS)
    ending = "|".join("[_-]*".join(s) + "[_-]*" for s in SECRET_SEGMENTS)
    name = rf"(?:[a-z0-9_-]*(?:{ending})|(?:[a-z0-9_-]*[_-])?(?:{segment})(?:[_-][a-z0-9_-]*)?|{'|'.join(SECRET_NAMES)})"
    return F.regexp_replace(c, rf"(?i)([?&]{name}=)[^&\s]*", "$1***")


MEDIA_PREFIX = "/api/v1/media/"


def media_path(url: Column, prefix: str = MEDIA_PREFIX) -> Column:
    """What follows the media prefix of a URL, without the query; null where the prefix is missing."""
    after = F.substring(url, F.locate(prefix, url) + F.lit(len(prefix)), F.length(url))
    return F.when(F.contains(url, F.lit(prefix)), F.substring_index(after, "?", 1))


#: Notes on how long a group's code is valid, in the order in which they are taken out.
QR_NOISE = (
    r"该二维码\s*\d+\s*天[内后]?\s*(?:[（(][^)）]*[)）]\s*)?(?:有效|失效)",
    r"(?:该|本|此)?二维码\s*\d+\s*天[内后]?\s*(?:有效|失效)",
    r"该二维码[^，。；;、\n]{0,30}?(?:有效|失效)",
    r"重新进入[将会]?更新",
)


def strip_qr_noise(c: Column) -> Column:
    """The text without notes on how long a code is valid; the rest of a sentence stays."""
    for pattern in QR_NOISE:
        c = F.regexp_replace(c, pattern, "")
    return c


def find_all_terms(terms: Column, text: Column) -> Column:
    """Whether any lower-cased term is part of the lower-cased text."""
    return F.exists(terms, lambda k: F.contains(F.lower(text), F.lower(k)))
