"""Consolidating pairwise matches into groups (problem 5).

The match graph is shrunk before it is solved. Each round first contracts chains: the
arcs through degree-two vertices are ranked by pointer doubling, so a chain of any length
becomes one edge in a logarithmic number of joins. It then strips the degree-one vertices.
What remains when no vertex has a degree below three is the core; it is solved by star
contraction. Each removed vertex points at one that was removed later or never; these ways
are shortened by pointer doubling too, so the labels come back in a logarithmic number of
joins, and no plan holds more than one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.components import connected_components, normal_edges
from canopy.session import cut


def _degrees(edges: DataFrame) -> DataFrame:
    """(v, d, lo, hi): degree, smallest and largest neighbour of each vertex."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).union(edges.select("b", "a"))
    return both.groupBy("v").agg(F.count("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"))


def _with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the degree and both extreme neighbours of each end."""
    deg = _degrees(edges)
    ends = lambda p: deg.select(F.col("v").alias(p), F.col("d").alias(f"d_{p}"), F.col("lo").alias(f"lo_{p}"), F.col("hi").alias(f"hi_{p}"))
    return cut(edges.join(ends("a"), "a").join(ends("b"), "b"))


def _rank_chains(edges: DataFrame) -> DataFrame:
    """(v, end, least) for both arcs out of each degree-two vertex.

    end: the vertex of another degree where the arc's chain stops, null on a closed ring;
    least: the smallest vertex on the way, which on a ring is the smallest of the ring.
    """
    out = edges.select(F.col("a").alias("t"), F.col("b").alias("h"), F.col("d_a").alias("d_t"), F.col("d_b").alias("d_h"), F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi")).union(
        edges.select("b", "a", "d_b", "d_a", "lo_a", "hi_a")
    )
    ahead = F.when(F.col("d_h") == 2, F.when(F.col("lo") == F.col("t"), F.col("hi")).otherwise(F.col("lo")))
    arcs = cut(
        out.where("d_t = 2 or d_h = 2").select(
            "t", "h", F.when(F.col("d_h") == 2, F.col("h")).alias("nt"), ahead.alias("nh"),
            F.when(F.col("d_h") != 2, F.col("h")).alias("end"), F.least("t", "h").alias("least"), F.col("d_t").alias("d"),
        )
    )
    while True:
        jump = arcs.select(F.col("t").alias("nt"), F.col("h").alias("nh"), F.col("nt").alias("nt2"), F.col("nh").alias("nh2"), F.col("end").alias("end2"), F.col("least").alias("least2"))
        arcs = cut(
            arcs.join(jump, ["nt", "nh"], "left").select(
                "t", "h", F.col("nt2").alias("nt"), F.col("nh2").alias("nh"), F.coalesce("end", "end2").alias("end"),
                F.least("least", F.coalesce("least2", "least")).alias("least"), "d", F.when(F.col("end").isNull() & F.col("end2").isNull(), F.col("least2") < F.col("least")).otherwise(F.lit(False)).alias("moved"), (F.col("end").isNull() & F.col("end2").isNotNull()).alias("ended"),
            )
        )
        if not arcs.where("moved or ended").take(1):
            return arcs.where("d = 2").select(F.col("t").alias("v"), "end", "least")
        arcs = arcs.drop("moved", "ended")


def _contract_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, edges) after replacing every chain by one edge between its ends.

    A ring loses all its edges; its smallest vertex stays for the others to point at.
    """
    ranked = _rank_chains(edges).groupBy("v").agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("least").alias("ring"))
    ranked = cut(ranked)
    records = ranked.select("v", F.coalesce("e1", "ring").alias("parent")).where("v <> parent")
    shortcuts = ranked.where("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    return records, cut(edges.where("d_a <> 2 and d_b <> 2").select("a", "b").union(shortcuts).distinct())


def _strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, edges) after removing every degree-one vertex; a lone edge keeps its smaller end."""
    leaf, parent = F.when(F.col("d_b") == 1, F.col("b")).otherwise(F.col("a")), F.when(F.col("d_b") == 1, F.col("a")).otherwise(F.col("b"))
    records = edges.where("d_a = 1 or d_b = 1").select(leaf.alias("v"), parent.alias("parent"))
    return records, edges.where("d_a > 1 and d_b > 1").select("a", "b")


def _top_parents(records: DataFrame, stages: int) -> DataFrame:
    """(v, parent) with the vertex that no stage removed at the end of every vertex's way up.

    Every vertex was removed once, and its parent later or never, so no way is longer than
    the number of stages; doubling the ways takes the logarithm of it in joins, each on
    records that were written before.
    """
    for _ in range(stages.bit_length()):
        above = records.select(F.col("v").alias("parent"), F.col("parent").alias("top"))
        records = cut(records.join(above, "parent", "left").select("v", F.coalesce("top", "parent").alias("parent")))
    return records


def consolidate(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges` (columns a, b of one orderable type).

    Vertices linked directly or indirectly share a root. Edges with a null end, loops and
    repeated edges in either order change nothing; no edges give no rows. Every round cuts
    its lineage in the shared checkpoint folder.
    """
    edges = cut(normal_edges(edges))
    stages: list[DataFrame] = []
    while True:
        full = _with_degrees(edges)
        low = full.agg(F.max((F.col("d_a") == 2) | (F.col("d_b") == 2)), F.max((F.col("d_a") == 1) | (F.col("d_b") == 1))).first()
        if not (low[0] or low[1]):
            break
        if low[0]:
            records, edges = _contract_chains(full)
            stages.append(records)
            full = _with_degrees(edges)
        records, edges = _strip_leaves(full)
        stages.append(records)
    core = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = (connected_components(core) if core.take(1) else core).toDF("v", "root")
    if not stages:
        return cut(labels)
    removed = _top_parents(cut(reduce(DataFrame.union, stages)), len(stages))
    restored = removed.join(labels.toDF("parent", "root"), "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
    # Roots that no stage removed and that aren't in the core have no row yet.
    return cut(labels.union(restored).union(removed.select("parent", "parent")).groupBy("v").agg(F.min("root").alias("root")))


def work_edges(works: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """Direct matches of works rows as edges (a, b) of work_ids.

    Rows that share a token (their label, or an identifier in lower case) are tied to the
    smallest row with that token, so a token of n rows gives n - 1 edges. Null and blank
    labels, null identifiers and such with nothing after the colon tie nothing; a pair
    whose label names no row is left out.
    """
    ids = F.filter(F.transform(F.coalesce("ids", F.array()), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & ~x.rlike(r"^([^:]*:)?\s*$"))
    label = F.when(F.trim("label") != "", F.concat(F.lit("L"), "label"))
    tokens = works.select("work_id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(label), F.transform(ids, lambda x: F.concat(F.lit("I"), x)))))).alias("token"))
    first = tokens.groupBy("token").agg(F.min("work_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = tokens.join(first.where("n > 1"), "token").where("work_id > first").select(F.col("first").alias("a"), F.col("work_id").alias("b"))
    named = first.where("token like 'L%'").select(F.expr("substring(token, 2)").alias("label"), "first")
    side = lambda c, to: named.select(F.col("label").alias(c), F.col("first").alias(to))
    pairs = match_pairs.select("label_a", "label_b").where("label_a <> label_b").distinct().join(side("label_a", "a"), "label_a").join(side("label_b", "b"), "label_b").select("a", "b")
    return shared.union(pairs)


def group_works(works: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(work_id, group_id) of each works row that is linked to another one.

    group_id is the smallest work_id of the group. Removed rows take part.
    """
    roots = consolidate(work_edges(works, match_pairs))
    least = roots.groupBy("root").agg(F.min("v").alias("group_id"))
    return roots.join(least, "root").select(F.col("v").alias("work_id"), "group_id")
