"""Packing token sequences by minimum bin slack.

Documents become token ids with a public tokenizer. Every full window of a document is a sequence of its own; what
remains of each document, less than a window, is packed whole. A histogram of the remaining lengths (at most one entry
per length, so 2,047 numbers at any input size) goes to the driver. There a bitset subset-sum dynamic programme picks,
for the longest length left, the multiset of other lengths that fills the window closest to its capacity; the
backtracked counts form a pattern that is applied as often as the counts allow. The patterns, at most a few thousand
rows, are joined back to the pieces, ranked within each length, so no task or driver sees the pieces of a whole group.

Defined results: null text counts as empty and gives one piece with the end id alone; equal rows and repeated
identifiers are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bytewords
from larkspur.llm.common import RANK_ROWS, materialise, prefix_ranks, text_slices

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces whose ids a worker remembers before it starts afresh: about 250 bytes each, in every worker as long as it lives.
CACHE = 150_000
#: Pieces handed to the tokenizer as one text.
CHUNK = 512

_LETTER, _DIGIT, _OTHER, _SPACE, _ODD = range(5)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kind[128:] = _ODD
    kind[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x27, 0x7F]] = _ODD
    return kind


class WordTokenizer:
    """The ids of texts under a word-splitting lower-casing BPE tokenizer, each distinct piece encoded once.

    Words of ASCII and Latin-1 letters, digits and punctuation are cut into the tokenizer's own pieces with numpy; any
    other word (apostrophes, other scripts, control characters, special tokens) goes to the tokenizer whole. White
    space separates pieces in this tokenizer, so the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.kind = _byte_classes()
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids: list[np.ndarray] = []

    def _pieces(self, seg: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes of a segment's pieces, and which of them are words for the tokenizer."""
        low = bytewords._LOWER[seg]
        kind = self.kind[seg]
        lead = np.flatnonzero(seg[:-1] == 0xC3) if len(seg) > 1 else np.zeros(0, np.int64)
        after = seg[lead + 1]
        lead = lead[(after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[seg[lead + 1] < 0x9F] + 1
        low[upper] += 0x20
        special = np.flatnonzero((seg[:-1] == 0x3C) & (seg[1:] == 0x7C)) if len(seg) > 1 else lead[:0]
        kind[special] = _ODD
        starts, ends = bytewords._edges(seg, kind != _SPACE, rows)
        whole_s = whole_e = starts[:0]
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            at = np.unique(np.searchsorted(starts, odd, side="right") - 1)
            whole_s, whole_e = starts[at], ends[at]
            mark = np.zeros(len(seg) + 1, np.int8)
            mark[whole_s] += 1
            np.subtract.at(mark, whole_e, 1)
            kind[np.cumsum(mark[:-1]).astype(bool)] = _SPACE
        first = kind != _SPACE
        change = np.ones(len(seg), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        change[rows[rows < len(seg)]] = True
        begin = np.flatnonzero(first & change)
        stop = np.append(np.flatnonzero(change), len(seg))
        end = stop[np.searchsorted(stop, begin, side="right")]
        words = np.concatenate([np.zeros(len(begin), bool), np.ones(len(whole_s), bool)])
        s, e = np.concatenate([begin, whole_s]), np.concatenate([end, whole_e])
        h = np.concatenate([bytewords.span_hashes(low, begin, end), bytewords.span_hashes(seg, whole_s, whole_e) ^ np.uint64(0x5851F42D4C957F2D)])
        order = np.argsort(s, kind="stable")
        return s[order], e[order], h[order], words[order]

    def _encode(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        text = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        out: list[np.ndarray | None] = [None] * len(text)
        plain = np.flatnonzero(~words).tolist()
        chunks = [plain[i : i + CHUNK] for i in range(0, len(plain), CHUNK)]
        for chunk, enc in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(text[i] for i in c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, "<u4")
            for i, part in zip(chunk, np.split(ids, np.flatnonzero(self.ends_word[ids])[:-1] + 1), strict=True):
                out[i] = part
        odd = np.flatnonzero(words).tolist()
        for i, enc in zip(odd, self.tokenizer.encode_batch_fast([text[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(enc.ids, "<u4")
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows)."""
        raw, offsets = bytewords.utf8(column)
        spans = []
        for lo, hi in bytewords.segments(raw, offsets):
            s, e, h, w = self._pieces(raw[lo:hi], offsets[(offsets >= lo) & (offsets < hi)] - lo)
            spans.append((s + lo, e + lo, h, w))
        if not spans:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        s, e, h, w = (np.concatenate(x) for x in zip(*spans, strict=True))
        import pandas as pd

        codes, distinct = pd.factorize(h)
        if len(self.place) > CACHE:
            self.forget()
        where = np.fromiter((self.place.get(x, -1) for x in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(where < 0)
        if len(new):
            first = np.full(len(distinct), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            at = first[new]
            where[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self.ids.extend(self._encode(raw, s[at], e[at], w[at]))
            self.place.update(zip(distinct[new].tolist(), where[new].tolist(), strict=True))
        parts = [self.ids[i] for i in where.tolist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        known = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        n = size[codes]
        done = np.cumsum(n)
        ids = known[np.arange(done[-1] if len(done) else 0) + np.repeat(begin[codes] - (done - n), n)]
        per_row = np.bincount(np.searchsorted(offsets, s, side="right") - 1, weights=n, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(per_row)])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document cut at multiples of the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path or tokenizer_path())
        for batch in text_slices(batches, "text"):
            ids, offsets = tok.encode(batch.column(1))
            row, start, length, crc, total = [], [], [], [], []
            for i in range(batch.num_rows):
                one = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(one), window):
                    piece = one[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(one))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_fill(counts: np.ndarray, room: int) -> list[int]:
    """The multiset of available lengths whose sum is closest to `room` without passing it, by bitset subset sum.

    Bit s of the set is on when some multiset sums to s. Longer lengths enter first; the sets after each copy of a
    length are kept so that the chosen sum can be traced back to counts.
    """
    reach, trail = 1, []
    full = (1 << (room + 1)) - 1
    for length in (np.flatnonzero(counts[: room + 1])[::-1]).tolist():
        if not length:
            continue
        for _ in range(min(int(counts[length]), room // length)):
            wider = (reach | (reach << length)) & full
            if wider == reach:
                break
            trail.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def fill_patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Minimum bin slack over the whole histogram: (lengths of one sequence, number of such sequences)."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns: list[tuple[list[int], int]] = []
    while (left := np.flatnonzero(counts)).size:
        longest = int(left[-1])
        counts[longest] -= 1
        chosen = [longest, *best_fill(counts, window - longest)]
        counts[longest] += 1
        used = np.bincount(chosen, minlength=window + 1)
        times = int((counts[used > 0] // used[used > 0]).min())
        counts -= used * times
        patterns.append((chosen, times))
    return patterns


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, id_col, text_col, path, window, end_id), "pieces")
    sizes = pieces.groupBy("length").count().collect()  # at most `window` rows
    histogram = {r["length"]: r["count"] for r in sizes}
    slots, first = [], 0
    taken: dict[int, int] = {}
    for chosen, times in fill_patterns(histogram, window):
        offset = 0
        for length, n in sorted(((x, chosen.count(x)) for x in set(chosen)), reverse=True):
            low = taken.get(length, 0)
            slots.append((length, low, low + n * times, n, first, offset))
            taken[length] = low + n * times
            offset += n * length
        first += times
    # A row per length of each pattern, a few thousand at any input size: every window has at most 2,047 patterns' lengths.
    plan = spark.createDataFrame(slots, "plan_length long, low long, high long, per_sequence long, first_sequence long, first_offset long")
    # Ranks within a length: any order will do, so rows are spread by a hash of the document; copies of one text and pieces
    # of one length are dealt over all buckets.
    bits = max(0, math.ceil(math.log2(max(1, sum(histogram.values()) / RANK_ROWS))))
    spread = pieces.withColumn("lot", F.xxhash64("doc_id", "start", "ids_crc32"))
    bucket = F.shiftright("lot", 64 - bits) if bits else F.lit(0)
    ranked = prefix_ranks(spread, ["length"], ["lot", "doc_id", "start", "ids_crc32"], bucket, "rank")
    at = F.col("rank") - F.col("low")
    joined = ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )
