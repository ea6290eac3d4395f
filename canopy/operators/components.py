"""Weakly connected components by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import cut, ship

#: Parameter: edges that a task contracts at a time.
BLOCK = 1_000_000


def normal_edges(edges: DataFrame) -> DataFrame:
    """Edges (a < b), each once: no loops, no nulls, no direction."""
    a, b = edges.columns[:2]
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number linked to each of n numbers by the edges (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a < b) of the same components: every task replaces up to BLOCK of its edges at a
    time by the stars of what they link, so no more edges are left than vertices in a block."""
    ship(edges.sparkSession)

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        ids = pc.unique(pa.chunked_array([*t["a"].chunks, *t["b"].chunks], t["a"].type))
        ids = ids.take(pc.sort_indices(ids))
        of = lambda c: pc.index_in(t[c], ids).to_numpy(zero_copy_only=False)
        label = _least_linked(of("a"), of("b"), len(ids))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield from pa.table({"a": ids.take(pa.array(label[moved])), "b": ids.take(pa.array(moved))}).combine_chunks().to_batches(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from stars(held)
                held, rows = [], 0
        if rows:
            yield from stars(held)

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: larger neighbours move to the least of the closed neighbourhood;
    small: the vertex and its smaller neighbours do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if large:
        moved = both.where("v > u").join(least, "u").select("m", F.col("v").alias("w"))
    else:
        moved = both.join(least, "u").select("m", F.col("v").alias("w")).union(least.select("m", "u"))
    return moved.where("m <> w").select(F.col("m").alias("a"), F.col("w").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """True if every vertex is the centre of its edges or has only one edge, to a centre."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    bad = ends.groupBy("v").agg(F.max("out").alias("out"), F.sum("into").alias("into")).agg(F.max(F.col("out") + F.col("into") > 1)).first()[0]
    return not bad


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): component is the smallest id linked to id, directly or indirectly.

    Every task first contracts the edges that it holds; then large-star and small-star
    contractions alternate until only stars are left. Hot vertices are pre-aggregated to a minimum and their edges stay spread over the tasks of the join,
    which adaptive execution may split. Null ends are left out, loops and repeated edges
    change nothing. vertices (column id): isolated ones form their own component.
    """
    src, dst = edges.columns[:2]
    known = edges.select(F.col(src).alias("id")).union(edges.select(dst)).where("id is not null")
    if vertices is not None:
        known = known.union(vertices.select(vertices.columns[0]).where(F.col(vertices.columns[0]).isNotNull()))
    stars = cut(_contracted(normal_edges(edges)))
    known = known.distinct()
    while not _are_stars(stars):
        stars = cut(_contracted(_star(_star(stars, True), False)))
    return known.join(stars.select(F.col("b").alias("id"), F.col("a").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
