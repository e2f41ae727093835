"""Who met whom: visits of the same cell at the same time, added up for each pair of users where they are found.

There may be far more meetings than visits, so no meeting is shuffled or sorted on disk. Users are dealt into blocks (see blocks.py), and where two blocks meet, the
meetings between a few users of one and all of the other are made and added up at a time. A task holds two blocks' visits and a bounded number of meetings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .trajectories import micros

#: Visits of a block; meetings made at once (of one user more, if it has more with a block); rows of a batch.
BLOCK, AT_ONCE, ROWS = 500_000, 1_000_000, 65_536


class _Side:
    """One block's visits, in order of (cell, s), with key (cell, s) and until (cell, the last start of another visit that lasts long enough beside this one)."""

    def __init__(self, u, cell, s, e, key, until):
        self.u, self.cell, self.s, self.e, self.key, self.until = u, cell, s, e, key, until

    def of(self, where: np.ndarray) -> "_Side":
        return _Side(self.u[where], self.cell[where], self.s[where], self.e[where], self.key[where], self.until[where])


def _between(one: _Side, two: _Side) -> tuple[np.ndarray, ...]:
    """The meetings of visits of one with visits of two: place in one, place in two. A meeting begins with the later visit's start; all visits last long enough."""
    first = np.searchsorted(two.key, one.key, "left")
    i, j = blocks.spread(np.searchsorted(two.key, one.until, "right") - first, first)
    first = np.searchsorted(one.key, two.key, "right")
    l, k = blocks.spread(np.searchsorted(one.key, two.until, "right") - first, first)  # noqa: E741
    return np.concatenate([i, k]), np.concatenate([j, l])


def _met(one: _Side, two: _Side, users: pa.Array, cells: pa.Array, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, times, minutes, cells) of the users of one with those of two; same: two has all of one's block, and each pair is wanted once."""
    i, j = _between(one, two)
    if same:
        kept = one.u[i] < two.u[j]
        i, j = i[kept], j[kept]
    if not len(i):
        return
    lasts = np.minimum(one.e[i], two.e[j]) - np.maximum(one.s[i], two.s[j])
    hundredths = np.floor(lasts / 6e7 * 100 + 0.5).astype(np.int64)  # of minutes, each rounded
    low = one.u.min()
    pair, cell = (one.u[i] - low) * len(users) + two.u[j], one.cell[i]
    wide, deep = int(hundredths.max()).bit_length(), max(1, len(cells) - 1).bit_length()
    if int(pair.max()).bit_length() + wide + deep < 63:
        packed = ((pair << deep | cell) << wide) | hundredths
        packed.sort()
        hundredths, cell, pair = packed & ((1 << wide) - 1), (packed >> wide) & ((1 << deep) - 1), packed >> (wide + deep)
    else:
        order = np.lexsort((cell, pair))
        hundredths, cell, pair = hundredths[order], cell[order], pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    other = new.copy()
    other[1:] |= cell[1:] != cell[:-1]
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(pair)))
    minutes = np.add.reduceat(hundredths, starts) / 100
    x, y = pair[starts] // len(users) + low, pair[starts] % len(users)
    before = np.append(0, np.cumsum(other))  # different cells of a pair, before each meeting
    offsets, different = before[np.append(starts, len(pair))], cell[other]
    a, b = np.minimum(x, y), np.maximum(x, y)
    for at in range(0, len(starts), ROWS):
        to = min(at + ROWS, len(starts))
        lists = pa.ListArray.from_arrays(pa.array(offsets[at : to + 1] - offsets[at], pa.int32()), cells.take(pa.array(different[offsets[at] : offsets[to]])))
        columns = [users.take(pa.array(a[at:to])), users.take(pa.array(b[at:to])), pa.array(times[at:to]), pa.array(minutes[at:to]), pc.binary_join(lists, ",")]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "times", "minutes", "cells"])


def _group(least: int):
    def run(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        """The pairs of two blocks' users, or of one's."""
        both, ends = pa.concat_tables(tables), np.cumsum([0, *map(len, tables)]).tolist()
        (users, u), (cells, cell) = blocks.ranked(both["u"]), blocks.ranked(both["cell"])
        s = both["s"].to_numpy()
        e = s + both["lasts"].to_numpy()
        times = np.unique(np.concatenate([s, e - least]))
        key, until = (cell * len(times) + np.searchsorted(times, t) for t in (s, e - least))
        rows = _Side(u, cell, s, e, key, until)
        sides = [rows.of(at + np.argsort(key[at:to], kind="stable")) for at, to in zip(ends, ends[1:])]
        one, two = sides[0], sides[-1]
        later = np.searchsorted(two.key, one.until, "right") - np.searchsorted(two.key, one.key, "left")
        earlier = np.searchsorted(two.key, one.key, "left") - np.searchsorted(np.sort(two.until), one.key, "left")
        made = np.cumsum(np.bincount(one.u, later + earlier, len(users)))
        part = (made // AT_ONCE).astype(np.int64)[one.u]
        for p in np.unique(part):
            yield from _met(one.of(part == p), two, users, cells, len(sides) == 1)

    return run


def meeting_pairs(visits: DataFrame, user: str, cell: str, start: str, end: str, least_minutes: float) -> DataFrame:
    """Pairs of users (a < b) that were in one cell at the same time for at least so long: how often, the minutes, each meeting's rounded to hundredths, and in which cells."""
    least = max(1, math.ceil(least_minutes * 6e7))
    rows = visits.select(F.col(user).alias("u"), F.col(cell).cast("string").alias("cell"), micros(start).alias("s"), (micros(end) - micros(start)).alias("lasts")).where(F.col("u").isNotNull() & F.col("cell").isNotNull() & (F.col("lasts") >= least))
    ids = rows.schema["u"].dataType
    out = T.StructType([T.StructField("a", ids), T.StructField("b", ids), *T._parse_datatype_string("times long, minutes double, cells string").fields])
    return blocks.apply(rows, "u", ["cell", "s"], BLOCK, _group(least), out)
