import random

import pytest

from canopy.operators import graph as G
from canopy.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame([p if len(p) == 3 else (*p,) for p in pairs], "src string, dst string" + (", weight double" if pairs and len(pairs[0]) == 3 else ""))


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def graph(spark, pairs, extra=()):
    e = edges(spark, pairs)
    v = G.vertices_of(e).union(spark.createDataFrame([(x,) for x in extra], "id string")) if extra else G.vertices_of(e)
    return v, e


def closure(pairs):
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            return reach
        reach |= more


def random_pairs(seed, n=9, m=14):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)})


def test_cycles_removed(spark, both_ways):
    v, e = G.remove_cycles(*graph(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")]))
    assert ids(v, "id") == ["D"] and e.count() == 0


def test_self_loop_removed(spark, both_ways):
    v, e = G.remove_cycles(*graph(spark, [("A", "B"), ("B", "B")]))
    assert ids(v, "id") == ["A"] and e.count() == 0


def test_cycles_against_closure(spark, both_ways):
    pairs = [(f"{seed}{a}", f"{seed}{b}") for seed in range(4) for a, b in random_pairs(seed)]
    on_cycle = {a for a, b in closure(set(pairs)) if a == b}
    v, e = G.remove_cycles(*graph(spark, pairs))
    assert set(ids(v, "id")) == {x for p in pairs for x in p} - on_cycle
    assert set(ids(e, "src", "dst")) == {p for p in pairs if not on_cycle & set(p)}
    sccs = {r["id"]: r["component"] for r in G.strong_components(edges(spark, pairs)).collect()}
    reach = closure({p for p in pairs if p[0] != p[1]})
    for a in sccs:
        assert sccs[a] == max(b for b in sccs if (a, b) in reach and (b, a) in reach)


def test_dangling(spark):
    v, e = G.remove_dangling(*graph(spark, [("A", "B"), ("B", "C")]))
    assert ids(v, "id") == ["A", "B"] and ids(e, "src", "dst") == [("A", "B")]
    ring = [("A", "B"), ("B", "C"), ("C", "A")]
    v, e = G.remove_dangling(*graph(spark, ring))
    assert v.count() == 3 and e.count() == 3


def test_dangling_keeps_isolated(spark):
    v, _ = G.remove_dangling(*graph(spark, [("A", "B")], ["X"]))
    assert ids(v, "id") == ["A", "X"]


def test_invert_undirected_keep_purge(spark):
    e = edges(spark, [("A", "B"), ("B", "A"), ("B", "C"), ("B", "C")])
    assert ids(G.invert(e), "src", "dst") == [("A", "B"), ("B", "A"), ("C", "B"), ("C", "B")]
    assert ids(G.undirected(e), "src", "dst") == [("A", "B"), ("B", "C")]
    some = spark.createDataFrame([("B",), ("C",)], "id string")
    assert ids(G.keep(e, some), "src", "dst") == [("B", "C")]
    assert ids(G.purge(e, some.where("id = 'C'")), "src", "dst") == [("A", "B"), ("B", "A")]


def test_weight_inversion(spark):
    import math

    assert G.invert_weight(edges(spark, [("A", "B", 2.0)])).first()["weight"] == pytest.approx(math.exp(-2))


def test_degrees(spark):
    v, e = graph(spark, [("A", "B"), ("C", "B")], ["X"])
    assert {tuple(r) for r in G.degrees(e, v).collect()} == {("A", 0, 1), ("B", 2, 0), ("C", 0, 1), ("X", 0, 0)}


def test_components_and_giant(spark, both_ways):
    v, e = graph(spark, [("A", "B"), ("C", "B"), ("D", "E")], ["X"])
    assert ids(G.components(v, e), "id", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D"), ("X", "X")]
    inside, kept = G.giant(v, e)
    assert ids(inside, "id") == ["A", "B", "C"] and kept.count() == 2


def test_giant_of_equal_components_and_of_nothing(spark, both_ways):
    assert ids(G.giant(*graph(spark, [("C", "D"), ("B", "A")]))[0], "id") == ["A", "B"]
    nothing = spark.createDataFrame([], "src string, dst string")
    assert G.giant(G.vertices_of(nothing), nothing)[0].count() == 0


@pytest.mark.parametrize("seed", range(1))
def test_components_of_random_graphs_and_long_chains(spark, both_ways, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_topological_levels(spark, both_ways):
    v, e = graph(spark, [("A", "B"), ("B", "C"), ("A", "C")], ["X"])
    assert ids(G.topological_levels(v, e), "id", "level") == [("A", 0), ("B", 1), ("C", 2), ("X", 0)]
    with pytest.raises(G.CycleError):
        G.topological_levels(*graph(spark, [("A", "B"), ("B", "A")]))


def test_propagate_counts_paths_and_finds_cycles(spark, both_ways):
    seeds = spark.createDataFrame([("D", 1.0, 2.0)], "id string, c double, s double")
    e = edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("A", "D")])
    assert sorted(tuple(r) for r in G.propagate(e, seeds).collect()) == [("A", 3.0, 6.0), ("B", 1.0, 2.0), ("C", 1.0, 2.0), ("D", 1.0, 2.0)]
    assert G.propagate(e, seeds.where("id = 'Z'")).count() == 0
    with pytest.raises(G.CycleError):
        G.propagate(edges(spark, [("A", "B"), ("B", "A")]), seeds.selectExpr("'A' as id", "c"))


@pytest.mark.parametrize("seed", range(2))
def test_shortest_paths(spark, both_ways, seed):
    rng = random.Random(seed)
    arcs = {(f"v{a}", f"v{b}"): float(rng.randrange(1, 5)) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.5}
    got = {(r["source"], r["id"]): (r["dist"], r["parent"]) for r in G.shortest_paths(edges(spark, [(*k, w) for k, w in arcs.items()]), spark.createDataFrame([("v0",), ("v1",)], "id string")).collect()}
    for s in ("v0", "v1"):
        dist = {s: 0.0}
        for _ in range(9):
            for (a, b), w in arcs.items():
                if a in dist and dist[a] + w < dist.get(b, 1e9):
                    dist[b] = dist[a] + w
        want = {(s, x): (d, min((a for (a, b), w in arcs.items() if b == x and a in dist and dist[a] + w == d), default=None) if x != s else None) for x, d in dist.items()}
        assert {k: v for k, v in got.items() if k[0] == s} == want


def test_minimum_forest(spark):
    got = G.minimum_forest(edges(spark, [("A", "B", 1.0), ("B", "C", 2.0), ("A", "C", 3.0), ("X", "Y", 5.0)]))
    assert ids(got, "src", "dst") == [("A", "B"), ("B", "C"), ("X", "Y")]


@pytest.mark.parametrize("seed", range(2))
def test_minimum_forest_against_kruskal(spark, seed):
    rng = random.Random(seed)
    arcs = sorted({(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}", float(rng.randrange(3))) for _ in range(18)})
    arcs = [a for i, a in enumerate(arcs) if a[0] != a[1] and not any(b[:2] == a[:2] for b in arcs[:i])]
    parent = {x: x for a in arcs for x in a[:2]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for a, b, w in sorted(arcs, key=lambda x: (x[2], x[0], x[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.append((a, b))
    assert ids(G.minimum_forest(edges(spark, arcs)), "src", "dst") == sorted(want)


def test_clean_drops_cycles_dangling_and_small_components(spark, both_ways):
    pairs = [("W1", "W3"), ("W1", "M"), ("W2", "W3"), ("W4", "M2"), ("C1", "C2"), ("C2", "C1")]
    v, e = G.clean(*graph(spark, pairs))
    assert ids(v, "id") == ["W1", "W2", "W3"] and ids(e, "src", "dst") == [("W1", "W3"), ("W2", "W3")]


@pytest.fixture
def steps(monkeypatch):
    """The frames written within blocks.py, one or two in each superstep."""
    from canopy.operators import blocks

    seen, cut = [], blocks.cut
    monkeypatch.setattr("canopy.operators.blocks.cut", lambda df: seen.append(1) or cut(df))
    return seen


def chain(n):
    return [(f"v{i:03}", f"v{i + 1:03}") for i in range(n)]


def test_levels_over_small_blocks_take_steps_by_tasks(spark, steps):
    got = ids(G.topological_levels(*graph(spark, chain(60)), block=2), "id", "level")
    assert got == [(f"v{i:03}", i) for i in range(61)]
    # 30 blocks in 4 tasks.
    assert len(steps) < 16


def test_cycles_over_small_blocks_take_steps_by_tasks(spark, steps):
    pairs = [*chain(60), ("v060", "v000"), ("v060", "w1"), ("w1", "w2"), ("w2", "w3")]
    assert ids(G.strong_components(edges(spark, pairs), block=2), "id", "component") == [(f"v{i:03}", "v060") for i in range(61)]
    # 32 blocks in 4 tasks, walked for the trim, the colours, the way back and the rest.
    assert len(steps) < 50


def test_cycles_are_found_in_one_task_once_they_fit_one(spark, steps):
    # Paths through all tasks lead to, between and from rings that lie in several tasks.
    pairs = [*chain(60), *[(f"v{(i * 7) % 60:03}", f"w{i:03}") for i in range(40)], *[(f"v{b:03}", f"v{a:03}") for a, b in ((10, 25), (20, 30), (40, 55))]]
    got = ids(G.strong_components(edges(spark, pairs), block=2), "id", "component")
    assert got == [(f"v{i:03}", "v030") for i in range(10, 31)] + [(f"v{i:03}", "v055") for i in range(40, 56)]
    # Numbering, components within tasks, one superstep of the trim, and the rest in one task.
    assert len(steps) < 13


def test_levels_finish_in_fewer_tasks_as_arcs_are_done(spark, monkeypatch):
    monkeypatch.setattr("canopy.operators.blocks.BLOCK", 40)
    rnd = random.Random(5)
    pairs = sorted({tuple(sorted(rnd.sample(range(100), 2))) for _ in range(300)})
    want = dict.fromkeys(range(100), 0)
    for a, b in pairs:
        want[b] = max(want[b], want[a] + 1)
    named = [(f"v{a:03}", f"v{b:03}") for a, b in pairs]
    at = {n: level for n, level in want.items() if any(n in p for p in pairs)}
    assert ids(G.topological_levels(*graph(spark, named), block=5), "id", "level") == sorted((f"v{n:03}", level) for n, level in at.items())
