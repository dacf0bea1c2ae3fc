"""Order-dependent choices over groups of any size: a fold with a small state, without gathering a group.

Rows are put in order over all groups and cut into parts, wherever a part ends. First every part is folded from each state in
which its first group may come in (a few thousand whole numbers; entries that reach one state go on as one), which gives a map
from entry to exit. The maps are then followed from part to part, two numbers each, and every part is folded once more from
the state that it really begins in. A group with a third of all rows spreads over as many parts as its rows need.

A step is written for whole numbers and numpy arrays alike: step(state, size) gives (next state, flag 0 or 1). State 0 is that
of a new group; states are below `states`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.scratch import written

Step = Callable[[Any, Any], tuple[Any, Any]]


def packing_step(most: int, chars: int) -> tuple[Step, int]:
    """Filled in order: a case takes `most` rows and `chars` characters, one row at least; the flag marks the first of a case."""
    wide = chars + 2  # a single row over the limit counts as one more than it

    def step(state: Any, size: Any) -> tuple[Any, Any]:
        n, used = state // wide, state % wide
        goes_on = (n > 0) & (n < most) & (used + size <= chars)
        return (n * goes_on + 1) * wide + used * goes_on + np.minimum(size, chars + 1), 1 - goes_on

    return step, (most + 1) * wide


def budget_step(chars: int) -> tuple[Step, int]:
    """Skip and go on: a row is taken where it fits what is left of the budget; the flag marks rows that are taken."""

    def step(state: Any, size: Any) -> tuple[Any, Any]:
        fits = state + size <= chars
        return state + size * fits, fits * 1

    return step, chars + 1


class _AllEntries:
    """A fold from every entry state at once."""

    def __init__(self, step: Step, states: int) -> None:
        self.step, self.now, self.at = step, np.arange(states), np.arange(states)
        self.flags, self.before, self.steps = np.zeros(states, np.int64), np.zeros(states, np.int64), 0

    def put(self, size: int) -> None:
        self.now, flag = self.step(self.now, size)
        self.flags = self.flags + flag
        self.steps += 1
        if self.steps & (self.steps - 1) == 0:
            self.merge()

    def merge(self) -> None:
        self.before += self.flags[self.at]
        self.now, place = np.unique(self.now, return_inverse=True)
        self.at, self.flags = place[self.at], np.zeros(len(self.now), np.int64)

    def map(self) -> bytes:
        self.merge()
        return zlib.compress(np.stack([self.now[self.at], self.before]).astype(np.int64).tobytes(), 1)


def _summaries(batches: Iterator[pa.RecordBatch], step: Step, states: int) -> Iterator[pa.RecordBatch]:
    """part, the keys of its first and last group, the first one's map, state and flags of the last one."""
    part = first = last = entries = None
    state = flags = 0

    def close() -> Iterator[pa.RecordBatch]:
        if part is not None:
            row = [part, first, last, entries.map(), int(state), int(flags)]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "first", "last", "map", "state", "flags"), row, strict=True))], schema=_SUMMARY_ARROW)

    for batch in batches:
        for p, key, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part:
                yield from close()
                part, first, last, entries, state, flags = p, key, key, _AllEntries(step, states), 0, 0
            if key != last:
                last, state, flags = key, 0, 0
            if key == first:
                entries.put(size)
            else:
                state, flag = step(state, size)
                flags += flag
    yield from close()


_SUMMARY_ARROW = pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("map", pa.binary()), ("state", pa.int64()), ("flags", pa.int64())])


def _begins(summaries: DataFrame, states: int) -> dict[int, tuple[int, int]]:
    """{part: (state, flags)} that each part's first group comes in with. A row a part goes through the driver, one at a time."""
    begins, key, state, flags = {}, None, 0, 0
    for row in summaries.orderBy("part").toLocalIterator():
        if row["first"] != key:
            state, flags = 0, 0
        begins[row["part"]] = (state, flags)
        if row["first"] == row["last"]:
            exits = np.frombuffer(zlib.decompress(bytes(row["map"])), np.int64).reshape(2, states)
            state, flags = int(exits[0, state]), flags + int(exits[1, state])
        else:
            state, flags = row["state"], row["flags"]
        key = row["last"]
    return begins


def folded(rows: DataFrame, keys: list[str], order: list[str], size: str, rule: tuple[Step, int], flag: str, running: str) -> DataFrame:
    """rows with `flag` (0 or 1) of each step and `running`, the flags of its group up to and with the row.

    `size` is a column of whole numbers, 0 or more. Rows of one group go by `order`; those equal in it, by size. Null keys are
    a group of their own; extra columns stay; an empty table stays empty.
    """
    (step, states), columns = rule, rows.columns
    key, number, part = "fold_key__", "fold_size__", "fold_part__"
    ready = rows.withColumns({key: F.to_json(F.struct(*keys)), number: F.col(size).cast("long")})
    by = [key, *order, number]
    parts = written(ready.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id().cast("long")), "fold")
    cut = parts.repartition(part).sortWithinPartitions(part, *by)
    summaries = cut.select(part, key, number).mapInArrow(lambda b: _summaries(b, step, states), "part long, first string, last string, map binary, state long, flags long")
    begins = rows.sparkSession.sparkContext.broadcast(_begins(summaries, states))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = None
        state = flags = 0
        for batch in batches:
            marked, ran = [], []
            for p, k, n in zip(*(batch.column(c).to_pylist() for c in (part, key, number)), strict=True):
                if p != at:
                    at, last, (state, flags) = p, k, begins.value[p]
                elif k != last:
                    last, state, flags = k, 0, 0
                state, one = step(state, n)
                flags += one
                marked.append(int(one))
                ran.append(int(flags))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marked, pa.int64()), pa.array(ran, pa.int64())], [*columns, flag, running])

    schema = T.StructType([*rows.schema.fields, T.StructField(flag, T.LongType()), T.StructField(running, T.LongType())])
    return cut.mapInArrow(put, schema)
