"""Top N items within every group (problem 6).

A mergeable aggregation: every task keeps a heap of at most N items for each group it
sees, the heaps are shuffled by group and merged in the order of score and identifier. What
crosses the network is at most N items per group and task, however large a group is, and
the merge holds one group's place at a time, however many groups there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import ship

#: Items that the heaps of a task hold together before they are passed on; heaps merge
#: later, so passing them on early changes no result and bounds a task's memory.
HELD = 500_000


class _Item(tuple):
    """(score, id); the least is the one to drop first: lowest score, then largest id."""

    __slots__ = ()

    def __lt__(self, other):
        return self[0] < other[0] or (self[0] == other[0] and self[1] > other[1])


class Heaps:
    """One heap of at most n items for each (group, measure)."""

    def __init__(self, n: int):
        self.n = n
        self.heaps: dict[tuple, list[_Item]] = {}
        self.held = 0

    def add(self, groups: pa.Array, measure: str, scores: np.ndarray, ids: pa.Array) -> None:
        """Offer a batch; items below the heap's least are dropped before any Python loop."""
        coded = groups.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        floors = np.full(len(names), -np.inf)
        for i, g in enumerate(names):
            heap = self.heaps.get((g, measure))
            if heap is not None and len(heap) == self.n:
                floors[i] = heap[0][0]
        keep = np.flatnonzero(scores >= floors[codes])
        for i, item in zip(codes[keep].tolist(), map(_Item, zip(scores[keep].tolist(), ids.take(pa.array(keep)).to_pylist()))):
            heap = self.heaps.setdefault((names[i], measure), [])
            if len(heap) < self.n:
                heapq.heappush(heap, item)
                self.held += 1
            elif heap[0] < item:
                heapq.heapreplace(heap, item)

    def drain(self) -> Iterator[tuple]:
        """(group, measure, place, score, id), best first in each group; empties the heaps."""
        for (group, measure), heap in self.heaps.items():
            for place, (score, item) in enumerate(sorted(heap, reverse=True), 1):
                yield group, measure, place, score, item
        self.heaps, self.held = {}, 0


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), schema.types)], schema=schema)
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), schema.types)], schema=schema)


SCHEMA = pa.schema([("g", pa.string()), ("m", pa.string()), ("place", pa.int64()), ("score", pa.float64()), ("item", pa.string())])


def _heaped(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n)
        for b in batches:
            names = b.schema.names
            groups, ids = b.column(names.index("g")), b.column(names.index("item"))
            for m in names[2:]:
                scores = b.column(names.index(m)).to_numpy(zero_copy_only=False).astype(float)
                at = np.flatnonzero(scores > 0)  # also drops nulls and what is no number
                if len(at):
                    take = pa.array(at)
                    heaps.add(groups.take(take), m, scores[at], ids.take(take))
            if heaps.held > HELD:
                yield from _batches(heaps.drain(), SCHEMA)
        yield from _batches(heaps.drain(), SCHEMA)

    return run


def _merged(n: int):
    """Places of the items of heaps that come sorted by group, measure, score and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, placed = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, m = b.column(0), b.column(1)
            own = (g[0].as_py(), m[0].as_py())
            changed = pc.or_(pc.not_equal(g.slice(1), g.slice(0, b.num_rows - 1)), pc.not_equal(m.slice(1), m.slice(0, b.num_rows - 1))).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            sizes = np.diff(np.append(starts, b.num_rows))
            place = np.arange(b.num_rows) - np.repeat(starts, sizes) + 1
            if own == last:
                place[: sizes[0]] += placed
            last, placed = (g[b.num_rows - 1].as_py(), m[b.num_rows - 1].as_py()), int(place[-1])
            best = pa.array(np.flatnonzero(place <= n))
            yield pa.RecordBatch.from_arrays([g.take(best), m.take(best), pa.array(place).take(best), b.column(3).take(best), b.column(4).take(best)], schema=SCHEMA)

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, measures: list[str], n: int) -> DataFrame:
    """(group, score_name, place, item) with the n best items of each group and measure.

    An item ranks if its score is a number above 0; null scores and NaN don't rank. Higher
    score first, then the smaller item in code point order; place counts from 1. Rows with
    a null group or item are left out; an item that stands on several rows of a group is
    offered as often as it stands there, so make items unique first. Empty input gives no
    rows. Other columns of `df` are not read.
    """
    ship(df.sparkSession)
    if n < 1:
        raise ValueError("n must be 1 or more")
    if len(set(measures)) != len(measures) or {"g", "item"} & set(measures):
        raise ValueError("measures must be distinct columns not called g or item")
    named = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("item"), *[F.col(m).cast("double").alias(m) for m in measures]
    )
    schema = "g string, m string, place long, score double, item string"
    partial = named.mapInArrow(_heaped(n), schema).repartition("g", "m")
    merged = partial.sortWithinPartitions("g", "m", F.desc("score"), "item").mapInArrow(_merged(n), schema)
    return merged.select(F.col("g").alias(group), F.col("m").alias("score_name"), "place", F.col("item").alias(item))


def latest_rows(df: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """(key, *columns): one row per key, the one with the latest time (a null time is oldest).

    Of several rows with that time the one whose columns compare greatest stays. Rows with
    a null key are left out, and other columns aren't read. An aggregation, so repeated
    keys shrink before the shuffle.
    """
    best = F.max(F.struct(F.col(time).alias("__time"), *columns))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__best")).select(key, *[F.col(f"__best.{c}").alias(c) for c in columns])
