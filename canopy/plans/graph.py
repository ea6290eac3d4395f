"""Queries of graph operators over the citations of raw_works, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import graph as G
from canopy.operators.sap import Sap, run_sap
from canopy.operators.steiner import pseudo_steiner
from canopy.session import cut, table
from canopy.sources.works import work_numbers


def cites(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the works that raw_works cite, by work number."""
    edges = cut(work_numbers(table(spark, folder, "raw_works").select("id", "referenced_works")))
    return G.vertices_of(edges), edges


def acyclic(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v, e = G.remove_cycles(*cites(spark, folder))
    return cut(v), cut(e)


def supply(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A three-layer DAG out of lineitem: orders cite parts, parts cite suppliers."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = line.select(name("o:", "l_orderkey").alias("src"), name("p:", "l_partkey").alias("dst")).union(line.select(name("p:", "l_partkey"), name("s:", "l_suppkey")))
    edges = cut(edges.dropna().distinct())
    return G.vertices_of(edges), edges


def graph_vertices(spark, folder):
    return cites(spark, folder)[0]


def graph_edges(spark, folder):
    return cites(spark, folder)[1]


def graph_degrees(spark, folder):
    v, e = cites(spark, folder)
    return G.degrees(e, v)


def graph_invert(spark, folder):
    return G.invert(cites(spark, folder)[1])


def graph_undirected(spark, folder):
    return G.undirected(cites(spark, folder)[1])


def _cited(spark, folder):
    return G.degrees(cites(spark, folder)[1]).where("in_degree >= 5").select("id")


def graph_keep(spark, folder):
    return G.keep(cites(spark, folder)[1], _cited(spark, folder))


def graph_purge(spark, folder):
    return G.purge(cites(spark, folder)[1], _cited(spark, folder))


def graph_remove_dangling(spark, folder):
    return G.remove_dangling(*cites(spark, folder))[0]


def graph_cycle_vertices(spark, folder):
    return G.strong_components(cites(spark, folder)[1]).select("id")


def graph_remove_cycles(spark, folder):
    return acyclic(spark, folder)[1]


def graph_wcc(spark, folder):
    return G.components(*acyclic(spark, folder))


def graph_giant(spark, folder):
    return G.giant(*acyclic(spark, folder))[0]


def graph_topo_levels(spark, folder):
    return G.topological_levels(*acyclic(spark, folder))


def graph_weight_invert(spark, folder):
    links = table(spark, folder, "links").select("link_seq", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")
    return G.invert_weight(links).select("link_seq", F.round("weight", 9).alias("weight"))


def clean_pipeline(spark, folder):
    return G.clean(*cites(spark, folder))[0]


def clean_edges(spark, folder):
    return G.clean(*cites(spark, folder))[1]


def _sap(spark, folder) -> Sap:
    return run_sap(*acyclic(spark, folder), written=True)


def sap_roots(spark, folder):
    return _sap(spark, folder).roots


def sap_root_connections(spark, folder):
    return _sap(spark, folder).forward.select("id", "connections")


def sap_leaves(spark, folder):
    return _sap(spark, folder).leaves


def sap_leaf_connections(spark, folder):
    return _sap(spark, folder).backward.select("id", "connections")


def sap_raw(spark, folder):
    return _sap(spark, folder).forward.select("id", "sap")


def sap_elaborate(spark, folder):
    return _sap(spark, folder).backward.select("id", "sap")


def sap_trunk(spark, folder):
    return _sap(spark, folder).trunk


def sap_categories(spark, folder):
    return _sap(spark, folder).nodes()


def sap_supply_categories(spark, folder):
    return run_sap(*supply(spark, folder), written=True).nodes()


#: Parameter: arcs of a block in queries that run over many blocks also where a graph is small.
SMALL_BLOCK = 2000


def graph_cycle_vertices_blocks(spark, folder):
    return G.strong_components(cites(spark, folder)[1], SMALL_BLOCK).select("id")


def graph_topo_levels_blocks(spark, folder):
    return G.topological_levels(*acyclic(spark, folder), SMALL_BLOCK)


def sap_categories_blocks(spark, folder):
    return run_sap(*acyclic(spark, folder), block=SMALL_BLOCK, written=True).nodes()


def sssp_distances_blocks(spark, folder):
    _, e, top = _sources(spark, folder)
    return G.shortest_paths(e, top, block=SMALL_BLOCK).select("source", "id", "dist")


def _sources(spark, folder):
    """The DAG and, as sources of ways, its vertices whose work number is divisible by 100."""
    v, e = acyclic(spark, folder)
    return v, e, cut(v.where("cast(substring(id, 2) as bigint) % 100 = 0"))


def sssp_distances(spark, folder):
    _, e, top = _sources(spark, folder)
    return G.shortest_paths(e, top).select("source", "id", "dist")


def steiner_subgraph(spark, folder):
    """What connects the vertices whose work number is divisible by 250, as a search connects its hits."""
    v, e = acyclic(spark, folder)
    hits = v.where("cast(substring(id, 2) as bigint) % 250 = 0").collect()
    return pseudo_steiner(v, e, [r["id"] for r in hits]).edges


def mst_forest(spark, folder):
    edges = cites(spark, folder)[1]
    weight = F.length(F.col("src")) + F.expr("cast(substring(src, -2) as int)") + F.expr("cast(substring(dst, -2) as int)")
    return G.minimum_forest(edges.withColumn("weight", weight.cast("double")))


_E = r"""
with recursive e as (select distinct src, dst from (
  select 'W' || nullif(regexp_extract(id, '[Ww]([0-9]+)\s*$', 1), '') src, 'W' || nullif(regexp_extract(u, '[Ww]([0-9]+)\s*$', 1), '') dst
  from (select id, unnest(referenced_works) u from raw_works)) where src is not null and dst is not null),
v as (select src id from e union select dst from e)
"""
_DAG = _E + """, reach(a, b) as (select src, dst from e union select r.a, e.dst from reach r join e on e.src = r.b),
bad as (select distinct a id from reach where a = b),
g as (select src, dst from e where src not in (select id from bad) and dst not in (select id from bad)),
gv as (select id from v where id not in (select id from bad))
"""
_SIDES = "both_ways as (select src a, dst b from {e} union select dst, src from {e}), link(a, b) as (select id, id from {v} union select l.a, w.b from link l join both_ways w on w.a = l.b), comp as (select a id, min(b) component from link group by 1)"
_CLEAN = _DAG + """,
loose as (select id from (select dst id, count(*) n from g group by 1) where n = 1 and id not in (select src from g)),
h as (select src, dst from g where src not in (select id from loose) and dst not in (select id from loose)),
hv as (select id from gv where id not in (select id from loose)), """ + _SIDES.format(e="h", v="hv") + """,
big as (select component from comp group by 1 order by count(*) desc, component limit 1),
inside as (select id from comp where component = (select component from big))
"""
_SAP = """,
indeg as (select dst id, count(*)::double d from g group by 1),
roots as (select id, d rootness from indeg where id not in (select src from g) order by d desc, id limit 20),
fwd as (select id, 1.0::double c, rootness s from roots union all select g.src, sum(c), sum(s) from fwd join g on g.dst = fwd.id group by g.src),
f as (select id, sum(c) cr, sum(s) sr from fwd group by 1),
leaves as (select id, cr leafness from f where id not in (select dst from g) order by cr desc, id limit 50),
bwd as (select id, 1.0::double c, leafness s from leaves union all select g.dst, sum(c), sum(s) from bwd join g on g.src = bwd.id group by g.dst),
b as (select id, sum(c) cl, sum(s) sl from bwd group by 1),
sap as (select f.id, coalesce(cl, 0) * sr + cr * coalesce(sl, 0) x from f left join b using (id)),
trunk as (select id, x trunkness from sap where x > 0 and id not in (select id from roots) and id not in (select id from leaves) order by x desc, id limit 20)
"""
_NODES = """
select id, case when rootness is not null then 'root' when trunkness is not null then 'trunk' when leafness is not null then 'leaf' else '' end as category,
  coalesce(rootness, 0) as rootness, coalesce(trunkness, 0) as trunkness, coalesce(leafness, 0) as leafness
from gv left join roots using (id) left join trunk using (id) left join leaves using (id)
"""
_SUPPLY = """
with recursive g as (select distinct 'o:' || l_orderkey src, 'p:' || l_partkey dst from lineitem union select distinct 'p:' || l_partkey, 's:' || l_suppkey from lineitem),
gv as (select src id from g union select dst from g)
"""
_SOURCES = ", top as (select id from gv where cast(substring(id, 2) as bigint) % 100 = 0)"

QUERIES = {
    f.__name__: f
    for f in (graph_vertices, graph_edges, graph_degrees, graph_invert, graph_undirected, graph_keep, graph_purge, graph_remove_dangling, graph_cycle_vertices, graph_remove_cycles, graph_wcc, graph_giant, graph_topo_levels, graph_weight_invert, clean_pipeline, clean_edges, sap_roots, sap_root_connections, sap_leaves, sap_leaf_connections, sap_raw, sap_elaborate, sap_trunk, sap_categories, sap_supply_categories, graph_cycle_vertices_blocks, graph_topo_levels_blocks, sap_categories_blocks, sssp_distances, sssp_distances_blocks, steiner_subgraph, mst_forest)
}
_MANY = ", many as (select dst id from e group by 1 having count(*) >= 5)"
ORACLE = {
    "graph_vertices": _E + "select id from v",
    "graph_edges": _E + "select src, dst from e",
    "graph_degrees": _E + "select id, (select count(*) from e where dst = id) as in_degree, (select count(*) from e where src = id) as out_degree from v",
    "graph_invert": _E + "select dst as src, src as dst from e",
    "graph_undirected": _E + "select distinct least(src, dst) as src, greatest(src, dst) as dst from e",
    "graph_keep": _E + _MANY + "select src, dst from e where src in (select id from many) and dst in (select id from many)",
    "graph_purge": _E + _MANY + "select src, dst from e where src not in (select id from many) and dst not in (select id from many)",
    "graph_remove_dangling": _E + "select id from v where not ((select count(*) from e where dst = id) = 1 and (select count(*) from e where src = id) = 0)",
    "graph_cycle_vertices": _DAG + "select id from bad",
    "graph_remove_cycles": _DAG + "select src, dst from g",
    "graph_wcc": _DAG + ", " + _SIDES.format(e="g", v="gv") + "select id, component from comp",
    "graph_giant": _DAG + ", " + _SIDES.format(e="g", v="gv") + "select id from comp where component = (select component from comp group by 1 order by count(*) desc, component limit 1)",
    "graph_topo_levels": _DAG + ", lev(id, level) as (select id, 0 from gv where id not in (select dst from g) union select g.dst, level + 1 from lev join g on g.src = lev.id) select id, cast(max(level) as int) as level from lev group by 1",
    "graph_weight_invert": "select link_seq, round(exp(-weight), 9) as weight from links",
    "clean_pipeline": _CLEAN + "select id from inside",
    "clean_edges": _CLEAN + "select src, dst from h where src in (select id from inside) and dst in (select id from inside)",
    "sap_roots": _DAG + _SAP + "select id, rootness from roots",
    "sap_root_connections": _DAG + _SAP + "select id, cr as connections from f",
    "sap_leaves": _DAG + _SAP + "select id, leafness from leaves",
    "sap_leaf_connections": _DAG + _SAP + "select id, cl as connections from b",
    "sap_raw": _DAG + _SAP + "select id, sr as sap from f",
    "sap_elaborate": _DAG + _SAP + "select id, sl as sap from b",
    "sap_trunk": _DAG + _SAP + "select id, trunkness from trunk",
    "sap_categories": _DAG + _SAP + _NODES,
    "sap_supply_categories": _SUPPLY + _SAP + _NODES,
    "sssp_distances": _DAG + _SOURCES + ", far(source, id, dist) as (select id, id, 0::double from top union select source, g.dst, dist + 1 from far join g on g.src = far.id) select source, id, min(dist) as dist from far group by 1, 2",
}
ORACLE |= {f"{q}_blocks": ORACLE[q] for q in ("graph_cycle_vertices", "graph_topo_levels", "sap_categories", "sssp_distances")}
