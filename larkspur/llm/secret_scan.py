"""Secret scans: entropy of sliding windows over candidate strings, beside three fixed patterns.

Candidates are unbroken strings of key characters. For each candidate the Shannon entropy of every window is kept by
incremental counts: as the window moves, one character's count falls and another's rises, and the sum of n log n is
updated by the two differences. The highest window decides against the threshold of the candidate's character class
(hexadecimal, mixed letters and digits, Base64 with its symbols). An allow-list suppresses candidates whose whole shape is
known to be harmless: identifiers of a fixed shape, paths, placeholders, runs of one class. Spans that the fixed patterns
found stay as they are; where a candidate meets one, what lies outside it is a candidate of its own.

Defined results: null text counts as empty; spans are in code points; an entropy span meets no span of the fixed patterns;
texts of any length are scanned whole, in one pass over the candidates and the fixed spans together.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs shorter than sixteen fail, and a run has no run before it, so the count may stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Strings of key characters that begin and end in a letter or digit (or Base64 padding).
CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_-]{18,}[A-Za-z0-9]={0,2}")
WINDOW = 20
#: Bits a character that the best window needs, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.7}
#: Whole shapes. Two quantifiers never compete for the same characters, so a match takes time in proportion to the string.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[A-Za-z]+"),  # a word
    re.compile(r"[0-9+/_-]+"),  # a number, date or telephone
    re.compile(r"(?i)(your|my|some|the|an?)?[/_-]?(example|sample|dummy|test|fake|placeholder|changeme|insert)[a-z]*+([/_-][a-z]++)*+[/_-]?[0-9]{0,4}"),
    re.compile(r"(.{1,4})\1+"),  # a short pattern again and again
    re.compile(r"(?i)(0?123456789(0|abcdef(ghijklmnopqrstuvwxyz)?)?|abcdef(ghijklmnopqrstuvwxyz)?(0?123456789)?){1,8}"),  # a sequence
    re.compile(r"[A-Za-z]+([/_-][A-Za-z]+)+"),  # a path or compound of words
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int

    def text(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if re.fullmatch(r"[A-Za-z0-9]+", s) else "base64"


def highest_entropy(s: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits a character, of the windows of s."""
    w = min(window, len(s))
    if not w:
        return 0.0
    part = [0.0] + [n * math.log2(n) for n in range(1, w + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for c in s[:w]:
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
    least = total
    for out, new in zip(s, s[w:]):  # noqa: B905  the window's first and next characters
        if out != new:
            n, m = counts[out], counts.get(new, 0)
            total += part[n - 1] - part[n] + part[m + 1] - part[m]
            counts[out], counts[new] = n - 1, m + 1
            least = min(least, total)
    return math.log2(w) - least / w


def is_allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOWED)


def base_spans(text: str) -> list[Span]:
    spans = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def entropy_spans(text: str, covered: list[Span], window: int = WINDOW) -> list[Span]:
    """Candidates of high entropy outside the covered spans, which are in order of their starts."""
    found, at = [], 0
    ends = list(accumulate((c.end for c in covered), max))  # spans of different kinds may lie in one another
    for m in CANDIDATE.finditer(text):
        start, stop = m.span()
        while at < len(covered) and ends[at] <= start:
            at += 1
        free, i = [], at
        while i < len(covered) and covered[i].start < stop:
            if covered[i].start > start:
                free.append((start, covered[i].start))
            start = max(start, covered[i].end)
            i += 1
        free.append((start, stop))
        for lo, hi in free:
            part = m if (lo, hi) == m.span() else CANDIDATE.search(text, lo, hi) if hi > lo else None
            if part and not is_allowed(part.group()) and highest_entropy(part.group(), window) >= THRESHOLDS[character_class(part.group())]:
                found.append(Span("entropy", *part.span()))
    return found


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed patterns, all spans), each by start and then kind."""
    base = base_spans(text)
    return base, sorted([*base, *entropy_spans(text, base)], key=lambda s: (s.start, KINDS.index(s.kind)))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for each row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
        for batch in text_slices(batches, "text"):
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for text in batch.column(1).to_pylist():
                base, every = scan_text(text or "")
                of = Counter(s.kind for s in every)
                for k in KINDS:
                    counts[k].append(of[k])
                digests.append(hashlib.sha256(",".join(s.text() for s in base).encode()).hexdigest())
                spans.append(",".join(s.text() for s in every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
