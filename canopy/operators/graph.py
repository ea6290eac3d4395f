"""Graph transforms, orders, propagation and shortest paths over vertex and edge DataFrames.

Edges have columns src and dst and may have weight; vertices have id. A graph is directed
unless a function says otherwise. Iterations run in supersteps over blocks of vertices
(blocks.py) and cut their lineage in the shared checkpoint folder, so no plan grows with
the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators import blocks
from canopy.operators.blocks import Numbered, Pile, arc_ends, inner_components, numbered, peel, relax, whole_components
from canopy.operators.components import connected_components
from canopy.session import cut


class CycleError(ValueError):
    """An operator that needs an acyclic graph got one with a cycle."""


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree) of every vertex, in one shuffle of the edge ends."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    if vertices is not None:
        ends = ends.union(vertices.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def invert(edges: DataFrame) -> DataFrame:
    """Every edge in the other direction; other columns stay."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def invert_weight(edges: DataFrame) -> DataFrame:
    """Weight w as exp(-w)."""
    return edges.withColumn("weight", F.exp(-F.col("weight")))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge (src < dst, or a loop) for each unordered pair."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def keep(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges between vertices of `ids`, parallel ones once."""
    ids = ids.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.select("src", "dst").distinct()


def purge(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges without an end in `ids`, parallel ones once."""
    ids = ids.select("id")
    outer = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return outer.select("src", "dst").distinct()


def remove_dangling(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without vertices that have one citing vertex and cite none; one pass."""
    bad = degrees(edges).where("out_degree = 0 and in_degree = 1").select("id")
    return vertices.join(bad, "id", "left_anti"), purge(edges, bad)


def _trim(graph: Numbered, arcs: DataFrame) -> DataFrame:
    """The arcs on or between cycles: vertices without in-arcs or without out-arcs go, again and
    again, until one task can hold the arcs that are left."""
    both = arcs.withColumn("slot", F.lit(0)).unionByName(arcs.select(F.col("t").alias("s"), F.col("s").alias("t"), "step", F.lit(1).alias("slot")))
    _, left, _ = peel(graph, both, arc_ends(arcs, graph.names), [], either=True, enough=blocks.BLOCK)
    return cut(arcs.join(left.toDF("s"), "s", "left_semi").join(left.toDF("t"), "t", "left_semi"))


def strong_components(edges: DataFrame, block: int | None = None) -> DataFrame:
    """(id, component) of the vertices in strongly connected components of two or more.

    Components within a task are found there and contracted. If arcs lead from task to
    task, what is left is trimmed to its cyclic core. A core that fits one task is searched
    there; in a larger one, every vertex is coloured with the largest vertex that reaches
    it, and what of a colour reaches its root again is a component; this repeats on the
    rest. component is the largest vertex of the component. block: see numbered().
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    graph = numbered(edges, block=block)
    inner, crossing = inner_components(graph, graph.arcs)
    if not crossing:
        return cut(graph.ids(inner, "n", "c").toDF("id", "component"))
    whole = lambda x: F.coalesce("c", x).alias(x)
    arcs = graph.arcs.select("s", "t", "step").join(inner.toDF("s", "c"), "s", "left").select(whole("s"), "t", "step")
    arcs = arcs.join(inner.toDF("t", "c"), "t", "left").select("s", whole("t"), "step").where("s <> t").distinct()
    core, found = _trim(graph, cut(arcs)), Pile()
    while size := core.count():
        if size <= blocks.BLOCK:
            found.add(whole_components(core))
            break
        graph = graph.shared(core.select(F.col("s").alias("n"), F.lit(1).alias("m")))
        still = core.withColumn("w", F.lit(0.0))
        starts = core.select(F.col("s").alias("n")).union(core.select("t")).distinct().where("n >= 0")
        colours = cut(relax(graph, still, starts.select(F.lit(0).alias("source"), "n", (-F.col("n")).cast("double").alias("d"))).select("n", (-F.col("d")).cast("long").alias("c")))
        tinted = still.join(colours.toDF("s", "c"), "s").join(colours.toDF("t", "c2"), "t").where("c = c2").select(F.col("t").alias("s"), F.col("s").alias("t"), "w")
        back = relax(graph, cut(tinted), colours.where("n = c").select(F.lit(0).alias("source"), "n", F.lit(0.0).alias("d")))
        reached = cut(back.select("n").join(colours, "n"))
        own = reached.where("n >= 0")
        found.add(own.join(own.groupBy("c").count().where("count > 1"), "c").select("n", "c"))
        gone = reached.select("n")
        core = _trim(graph, cut(core.join(gone.toDF("s"), "s", "left_anti").join(gone.toDF("t"), "t", "left_anti")))
    if found.frames:
        outer = cut(found.all()).toDF("n", "outer")
        joined = inner.join(outer.toDF("c", "outer"), "c", "left").select("n", F.coalesce("outer", "c").alias("c"))
        inner = joined.union(outer.join(inner, "n", "left_anti"))
    return cut(graph.ids(inner, "n", "c").toDF("id", "component"))


def remove_cycles(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without any vertex that lies on a cycle, loops included."""
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    bad = cut(strong_components(edges).select("id").union(loops).distinct())
    return vertices.join(bad, "id", "left_anti"), purge(edges, bad)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) ignoring direction; component is its smallest vertex."""
    return connected_components(edges.select("src", "dst"), vertices)


def giant(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest component ignoring direction; of equally large ones the one with the smallest vertex."""
    labels = cut(components(vertices, edges))
    top = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    inside = labels.join(top, "component", "left_semi").select("id")
    return inside, keep(edges, inside)


def topological_levels(vertices: DataFrame, edges: DataFrame, block: int | None = None) -> DataFrame:
    """(id, level): the longest path that ends in a vertex; (level, id) is a topological order.

    Raises CycleError if there is a cycle.
    """
    return levels_of(numbered(cut(edges.select("src", "dst").distinct()), vertices, block))


def levels_of(graph: Numbered, named: bool = True) -> DataFrame:
    """As topological_levels() of a numbered graph; without `named`, ids are its numbers."""
    levels, _, left = peel(graph, graph.arcs.withColumn("slot", F.lit(0)), graph.starts(), [])
    if left:
        raise CycleError("graph has a cycle")
    levels = graph.ids(levels, "n") if named else levels.where("n >= 0")
    return cut(levels.select(F.col("n").alias("id"), "level"))


def propagate(edges: DataFrame, seeds: DataFrame, graph: Numbered | None = None) -> DataFrame:
    """Sums of path-weighted seeds: each value column of `seeds` (id, ...) flows from a vertex
    to every vertex that cites it, along all paths at once; rows for what is reached.

    A vertex passes its sums on when all that flows into it is in, so every edge is walked
    once, whatever the number of paths; sums are exact below 2^53. Raises CycleError if the
    graph has a cycle anywhere. graph: the distinct edges and written seeds, numbered
    with cited vertices as s and citing ones as t.
    """
    values = [c for c in seeds.columns if c != "id"]
    if graph is None:
        seeds = cut(seeds)
        edges = cut(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
        graph = numbered(edges, seeds)
    first = graph.numbers(seeds.withColumn("_ways", F.lit(1.0)), "id").withColumnRenamed("id", "n")
    columns = [*values, "_ways"]
    starts = graph.starts().join(first, "n", "left").select("n", "o0", "o1", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    sums, _, left = peel(graph, graph.arcs.withColumn("slot", F.lit(0)), starts, columns)
    if left:
        raise CycleError("graph has a cycle")
    return cut(graph.ids(sums.where("_ways > 0"), "n").select(F.col("n").alias("id"), *values))


def lightest(edges: DataFrame) -> DataFrame:
    """(src, dst, w): the least weight of each pair, 1 where edges have no weight; written."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return cut(edges.groupBy("src", "dst").agg(F.min(weight).alias("w")))


def shortest_paths(edges: DataFrame, sources: DataFrame, block: int | None = None) -> DataFrame:
    """(source, id, dist, parent): the shortest distance from every source to what it reaches.

    Edges have a weight above 0, or all weigh 1. Of equally short ways the one over the
    smallest parent counts.
    """
    arcs, sources = lightest(edges), cut(sources.select("id").distinct())
    return paths_from(numbered(arcs, sources, block), arcs, sources)


def paths_from(graph: Numbered, arcs: DataFrame, sources: DataFrame, named: bool = True) -> DataFrame:
    """As shortest_paths() of a numbered graph and its arcs (src, dst, w) by id; without
    `named`, ids are its numbers, also in `sources`, and there are no parents."""
    if not named:
        starts = sources.select(F.col("id").alias("source"), F.col("id").alias("n"), F.lit(0.0).alias("d"))
        return relax(graph, graph.arcs, starts).where("n >= 0").select("source", F.col("n").alias("id"), F.col("d").alias("dist"))
    starts = graph.numbers(sources, "id").select(F.col("id").alias("source"), F.col("id").alias("n"), F.lit(0.0).alias("d"))
    best = cut(graph.ids(relax(graph, graph.arcs, starts), "source", "n").select("source", F.col("n").alias("id"), F.col("d").alias("dist")))
    ways = best.join(arcs.withColumnRenamed("src", "id"), "id").select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.col("id").alias("parent"))
    last = ways.where("source <> id").groupBy("source", "id").agg(F.min(F.struct("dist", "parent")).alias("o"))
    return cut(best.join(last, ["source", "id"], "left").select("source", "id", "dist", F.col("o.parent").alias("parent")))


def minimum_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the minimum spanning forest ignoring direction.

    Every round each component takes its lightest edge to another one (ties by src, then
    dst), and components joined by such edges merge. The order of ties is total, so the
    forest is unique and the same as with edges taken one by one in that order.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    open_ = cut(edges.where("src <> dst").groupBy(F.col("src").alias("s"), F.col("dst").alias("d")).agg(F.min(weight).alias("w")).select("s", "d", "w", F.col("s").alias("a"), F.col("d").alias("b")))
    chosen = Pile()
    while open_.take(1):
        order = F.struct("w", "s", "d", "a", "b")
        ends = open_.select(F.col("a").alias("c"), order.alias("e")).union(open_.select("b", order))
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen.add(best.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("w").alias("weight")))
        merged = cut(connected_components(best.select("a", "b")))
        moved = open_.join(merged.toDF("a", "ca"), "a").join(merged.toDF("b", "cb"), "b").where("ca <> cb")
        open_ = cut(moved.select("s", "d", "w", F.col("ca").alias("a"), F.col("cb").alias("b")))
    if not chosen.frames:
        return edges.where(F.lit(False)).select("src", "dst", weight.alias("weight"))
    return chosen.all()


def citation_graph(citations: DataFrame, mains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of citations (src, dst): parallel edges once; mains (id) without citations stay."""
    edges = citations.select("src", "dst").dropna().distinct()
    vertices = vertices_of(edges)
    if mains is not None:
        vertices = vertices.union(mains.select("id").dropna()).distinct()
    return vertices, edges


def clean(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest component of the graph without cycles and without dangling vertices."""
    v, e = remove_cycles(cut(vertices), cut(edges))
    e = cut(e)
    v, e = remove_dangling(v, e)
    v, e = cut(v), cut(e)
    inside, _ = giant(v, e)
    inside = cut(inside)
    return inside, keep(e, inside)
