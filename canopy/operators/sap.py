"""Tree of Science: roots, trunk and leaves by propagating path counts through a citation DAG."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.blocks import numbered
from canopy.operators.graph import propagate
from canopy.session import cut


@dataclass
class Sap:
    """Results: roots (id, rootness), leaves (id, leafness), trunk (id, trunkness),
    forward (id, connections, sap) from the roots, backward (same) from the leaves."""

    roots: DataFrame
    leaves: DataFrame
    trunk: DataFrame
    forward: DataFrame
    backward: DataFrame
    vertices: DataFrame

    def nodes(self) -> DataFrame:
        """(id, category, rootness, trunkness, leafness) of every vertex; scores outside the lists are 0."""
        all_ = self.vertices.join(self.roots, "id", "left").join(self.trunk, "id", "left").join(self.leaves, "id", "left")
        category = F.when(F.col("rootness").isNotNull(), "root").when(F.col("trunkness").isNotNull(), "trunk").when(F.col("leafness").isNotNull(), "leaf").otherwise("")
        score = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        return all_.select("id", category.alias("category"), score("rootness"), score("trunkness"), score("leafness"))


def _top(df: DataFrame, score: str, n: int) -> DataFrame:
    """The n highest scores, ties by the smaller id; none for n of 0 or less."""
    return df.orderBy(F.desc(score), "id").limit(max(n, 0))


def run_sap(vertices: DataFrame, edges: DataFrame, roots: int = 20, trunks: int = 20, leaves: int = 50, block: int | None = None, written: bool = False) -> Sap:
    """Scores of a directed acyclic graph in which src cites dst.

    Roots are cited and cite nothing, the most cited first. Path counts and root scores
    flow from the roots to what cites them in one pass, leaves are the uncited vertices
    with most paths to roots, and a second pass flows back from them. A vertex's sap is
    paths from leaves x root scores + paths to roots x leaf scores; the trunk has the most
    sap without being a root or leaf.
    Raises CycleError if the graph has a cycle. written: edges (src, dst) are distinct and
    written already.
    """
    edges = edges if written else cut(edges.select("src", "dst").distinct())
    graph = numbered(edges, vertices, block)
    vertices = graph.names.select("id")
    graph.arcs = cut(graph.arcs)
    deg = graph.names.select("id", F.col("o0").alias("in_degree"), F.col("o1").alias("out_degree"))
    top_roots = cut(_top(deg.where("out_degree = 0 and in_degree > 0").select("id", F.col("in_degree").cast("double").alias("rootness")), "rootness", roots))
    forward = propagate(edges, top_roots.select("id", F.lit(1.0).alias("connections"), F.col("rootness").alias("sap")), graph.turned())
    open_ = deg.where("in_degree = 0").join(forward.where("connections > 0"), "id").select("id", F.col("connections").alias("leafness"))
    top_leaves = cut(_top(open_, "leafness", leaves))
    backward = propagate(edges, top_leaves.select("id", F.lit(1.0).alias("connections"), F.col("leafness").alias("sap")), graph)
    both = forward.join(backward.select("id", F.col("connections").alias("cl"), F.col("sap").alias("sl")), "id", "left")
    sap = both.select("id", (F.coalesce("cl", F.lit(0.0)) * F.col("sap") + F.col("connections") * F.coalesce("sl", F.lit(0.0))).alias("trunkness")).where("trunkness > 0")
    inner = sap.join(top_roots, "id", "left_anti").join(top_leaves, "id", "left_anti")
    return Sap(top_roots, top_leaves, cut(_top(inner, "trunkness", trunks)), forward, backward, vertices)
