"""Periodic runs of words by partition refinement.

For length 1, 2, 3 ... the positions of a text fall into classes: two positions are in one class when the factors of that
length that begin there are equal. A class of length p + 1 is a part of a class of length p, cut by the class of the
following position; only the smaller parts of what was cut at the last length need a look (the largest part of each class
stays behind), so all lengths together take n log n steps. Every position keeps its neighbour, the next member of its class.
While neighbours are exactly p apart at length p, a square of period p begins there, and p is its smallest period: a
smaller one would put a nearer member into the class. Squares of one period at consecutive positions are one run.

The classes are segments of one permutation and a linked list, and a length is one round of array operations over all texts
of a slice. A neighbour pair remembers the length at which it came about, so a square is read off when the pair is parted
or at the end, and lengths at which nothing is cut cost nothing.

Defined results: null and empty texts have no words and no runs; words are compared whole; texts of any length are one
piece (about 60 bytes a word are held); a null identifier stays null and repeated rows are separate documents; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import text_slices

#: A run has at least so many words and so many periods.
MIN_LENGTH = 6
MIN_PERIODS = 4
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all [start, start + count), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Refinement:
    """Classes of equal factors over several texts at once, refined length by length."""

    def __init__(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, most: np.ndarray):
        """words: a number per position; first, last, most: of each position's text the first position, the end and the longest period."""
        n = len(words)
        self.first, self.last, self.most = first, last, most
        order = np.lexsort((words, first)).astype(np.int32)
        change = np.ones(n, bool)
        change[1:] = (words[order[1:]] != words[order[:-1]]) | (first[order[1:]] != first[order[:-1]])
        starts = np.flatnonzero(change).astype(np.int32)
        counts = np.diff(np.append(starts, n)).astype(np.int32)
        # A class is named by where its segment begins in `members`.
        self.members, self.place, self.of = order, np.empty(n, np.int32), np.empty(n, np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)
        self.of[order] = np.repeat(starts, counts)
        self.size = np.zeros(n, np.int32)
        self.size[starts] = counts
        self.next, self.back = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        same = ~change[1:]
        self.next[order[:-1][same]] = order[1:][same]
        self.back[order[1:][same]] = order[:-1][same]
        self.since = np.ones(n, np.int32)
        self.moved = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def read_off(self, at: np.ndarray, upto: int | None) -> None:
        """Squares of the neighbour pairs that begin at `at` and were together up to a length."""
        at = at[self.next[at] >= 0]
        d = self.next[at] - at
        ok = (self.since[at] <= d) & (at + 2 * d <= self.last[at]) & (d <= self.most[at])
        if upto is not None:
            ok &= d <= upto
        if ok.any():
            self.squares.append((at[ok], d[ok]))

    def refine(self, pending: np.ndarray, p: int) -> np.ndarray:
        """From length p to p + 1 by the members of the small classes; the members of the new small classes."""
        x = pending[pending > self.first[pending]] - 1
        x = x[(x + p < self.last[x]) & (p < self.most[x])]
        x = x[self.size[self.of[x]] > 1]
        if not len(x):
            return x
        key = np.lexsort((x, self.of[x + 1], self.of[x]))
        x = x[key].astype(np.int32)
        old, by = self.of[x], self.of[x + 1]
        new_class = np.ones(len(x), bool)
        new_class[1:] = old[1:] != old[:-1]
        new_group = new_class.copy()
        new_group[1:] |= by[1:] != by[:-1]
        class_at, group_at = np.flatnonzero(new_class), np.flatnonzero(new_group)
        classes = old[class_at].astype(np.int64)
        taken = np.diff(np.append(class_at, len(x)))
        rest = self.size[classes] - taken
        groups = np.diff(np.append(group_at, len(x)))
        self._relink(x, old, new_group, p)
        # The taken members go to the end of their class's segment, in the order of their groups.
        slots = _ranges(classes + rest, taken)
        self.moved[x] = True
        free = slots[~self.moved[self.members[slots]]]
        own = self.place[x]
        holes = own[own < np.repeat(classes + rest, taken)]
        self.members[holes] = self.members[free]
        self.place[self.members[holes]] = holes
        self.members[slots], self.place[x] = x, slots
        self.moved[x] = False
        names = slots[group_at]
        self.size[classes] = rest
        self.size[names] = groups
        self.of[x] = np.repeat(names, groups)
        # The largest part of each class stays behind.
        class_of_group = np.cumsum(new_class[group_at]) - 1
        first_group = np.flatnonzero(new_class[group_at])
        largest = np.maximum.reduceat(groups, first_group)
        kept_rest = rest >= largest
        is_largest = (groups == largest[class_of_group]) & ~kept_rest[class_of_group]
        seen = np.cumsum(is_largest)
        behind = is_largest & (seen - np.repeat(seen[first_group] - is_largest[first_group], np.diff(np.append(first_group, len(groups)))) == 1)
        small = x[np.repeat(~behind, groups)]
        left = ~kept_rest & (rest > 0)
        return np.concatenate([small, self.members[_ranges(classes[left], rest[left])]])

    def _relink(self, x: np.ndarray, old: np.ndarray, new_group: np.ndarray, p: int) -> None:
        """Take x (in the order of class, group, position) out of the lists of their classes and make lists of the groups."""
        line = np.lexsort((x, old))
        y = x[line]
        opens = np.ones(len(y), bool)
        opens[1:] = self.next[y[:-1]] != y[1:]
        closes = np.append(opens[1:], True)
        before, after = self.back[y[opens]], self.next[y[closes]]
        following = np.full(len(x), -1, np.int32)
        following[:-1][~new_group[1:]] = x[1:][~new_group[1:]]
        parted = following != self.next[x]
        has = before >= 0
        self.read_off(before[has], p)
        self.read_off(x[parted], p)
        self.next[before[has]] = after[has]
        self.since[before[has]] = p + 1
        self.back[after[after >= 0]] = before[after >= 0]
        self.next[x] = following
        self.since[x[parted]] = p + 1
        self.back[x] = -1
        inner = following >= 0
        self.back[following[inner]] = x[inner]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of the squares of smallest periods."""
        pending, p = np.arange(len(self.of)), 1
        while len(pending):
            pending = self.refine(pending, p)
            p += 1
        self.read_off(np.arange(len(self.of)), None)
        at, d = (np.concatenate([s[i] for s in self.squares]).astype(np.int64) if self.squares else np.zeros(0, np.int64) for i in (0, 1))
        return at, d


def runs_of(words: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, period) of the runs of the texts whose words are numbers and lie between the offsets, by position
    and then period."""
    n = np.diff(offsets)
    first, last, most = (np.repeat(v, n).astype(np.int32) for v in (offsets[:-1], offsets[1:], n // max(2, min_periods)))
    at, d = Refinement(words, first, last, most).run()
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])
    start = np.flatnonzero(opens)
    length = np.diff(np.append(start, len(at))) - 1 + 2 * d[start]
    at, d = at[start], d[start]
    long = length >= np.maximum(min_length, min_periods * d)
    at, length, d = at[long], length[long], d[long]
    order = np.lexsort((d, at))
    return at[order], length[order], d[order]


def _word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, offsets of the texts)."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0D]+")
    flat, doc = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc[some.to_numpy(zero_copy_only=False)], minlength=len(texts)), out=offsets[1:])
    return flat.filter(some), offsets


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period) and collapsed of each row of docs: its words, joined
    by one space, without those that lie in a run after its first period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            flat, offsets = _word_lists(batch.column(1))
            words = flat.dictionary_encode().indices.to_numpy()
            at, length, d = runs_of(words, offsets, min_length, min_periods)
            doc = np.searchsorted(offsets, at, side="right") - 1
            dropped = np.zeros(len(words) + 1, np.int32)
            np.add.at(dropped, at + d, 1)
            np.add.at(dropped, at + length, -1)
            keep = np.cumsum(dropped[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat.filter(pa.array(keep))), " ")
            cuts = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
            fields = [pa.array(v.astype(np.int64)) for v in (at - offsets[doc], length, d)]
            runs = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, text], ["doc_id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, f"doc_id {kind}, runs {_RUNS}, collapsed string")


def longest_relative(runs: Column) -> Column:
    """Of an array of runs the one with most periods, exactly compared; the first of equals; null where there is none."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), more))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with most periods and SHA-256 digests of the runs and the collapsed text."""
    found = found.withColumn("best", longest_relative(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id, text) where a tenth of the texts, by a hash of the identifier, is periodic from some word on."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))
