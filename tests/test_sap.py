import random

import pytest

from canopy.operators.graph import CycleError, vertices_of
from canopy.operators.sap import run_sap


def run(spark, pairs, extra=(), **options):
    e = spark.createDataFrame(pairs, "src string, dst string")
    v = vertices_of(e).union(spark.createDataFrame([(x,) for x in extra], "id string"))
    return run_sap(v, e, **options)


def nodes(result):
    return {r["id"]: (r["category"], r["rootness"], r["trunkness"], r["leafness"]) for r in result.nodes().collect()}


def test_chain(spark, both_ways):
    assert nodes(run(spark, [("A", "B"), ("B", "C")])) == {"A": ("leaf", 0, 0, 1), "B": ("trunk", 0, 2, 0), "C": ("root", 1, 0, 0)}


def test_diamond(spark, both_ways):
    got = nodes(run(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]))
    assert got == {"A": ("leaf", 0, 0, 2), "B": ("trunk", 0, 4, 0), "C": ("trunk", 0, 4, 0), "D": ("root", 2, 0, 0)}


def test_cycle_is_an_error(spark, both_ways):
    with pytest.raises(CycleError):
        run(spark, [("A", "B"), ("B", "A")])


def test_path_counts_beyond_64_bits(spark):
    pairs = [("L", "A0"), ("L", "B0")] + [(f"{x}{i}", f"{y}{i + 1}") for i in range(64) for x in "AB" for y in "AB"] + [("A64", "R"), ("B64", "R")]
    got = nodes(run(spark, pairs))
    assert got["L"][0] == "leaf" and got["L"][3] == 2.0**65 and got["R"][0] == "root"
    assert sum(v[0] == "trunk" for v in got.values()) == 20


def test_one_root_only(spark, both_ways):
    got = nodes(run(spark, [("L1", "T1"), ("L2", "R1"), ("T1", "R1"), ("L3", "R2")], ["ISO"], roots=1))
    assert got["R1"][0] == "root" and got["T1"][0] == "trunk" and got["L3"][0] == got["ISO"][0] == "" and got["L3"][3] == 0


@pytest.mark.parametrize("seed", range(4))
def test_against_path_enumeration(spark, both_ways, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"v{a}", f"v{b}") for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.35}) or [("v0", "v1")]
    out = {x: [b for a, b in pairs if a == x] for p in pairs for x in p}
    indeg = {x: sum(b == x for _, b in pairs) for x in out}
    roots = {x: float(indeg[x]) for x in out if not out[x] and indeg[x]}

    def paths(x, weight):
        return (weight[x] if x in weight else 0) + sum(paths(y, weight) for y in out[x])

    up = {x: [a for a, b in pairs if b == x] for x in out}
    one = dict.fromkeys(roots, 1.0)
    leaves = {x: paths(x, one) for x in out if not indeg[x] and paths(x, one)}

    def back(x, weight):
        return (weight[x] if x in weight else 0) + sum(back(y, weight) for y in up[x])

    sap = {x: back(x, dict.fromkeys(leaves, 1.0)) * paths(x, roots) + paths(x, one) * back(x, leaves) for x in out}
    got = nodes(run(spark, pairs))
    for x in out:
        category = "root" if x in roots else "leaf" if x in leaves else "trunk" if sap[x] > 0 else ""
        assert got[x] == (category, roots.get(x, 0.0), sap[x] if category == "trunk" else 0.0, leaves.get(x, 0.0))


def test_small_blocks_take_steps_by_tasks(spark, monkeypatch):
    from canopy.operators import blocks

    seen, cut = [], blocks.cut
    monkeypatch.setattr("canopy.operators.blocks.cut", lambda df: seen.append(1) or cut(df))
    pairs = [(f"v{i:03}", f"v{i + k:03}") for i in range(60) for k in (1, 2) if i + k < 60]
    got, many = nodes(run(spark, pairs, block=4)), len(seen)
    assert got == nodes(run(spark, pairs))
    # 30 blocks in 4 tasks, walked there and back.
    assert many < 32


def test_scores_finish_in_one_task_once_the_rest_fits_one(spark, monkeypatch):
    from canopy.operators import blocks

    seen, cut = [], blocks.cut
    monkeypatch.setattr("canopy.operators.blocks.cut", lambda df: seen.append(1) or cut(df))
    # Ways change tasks again and again: ids don't follow the order.
    pairs = [(f"v{i * 7 % 60:03}", f"v{(i + k) * 7 % 60:03}") for i in range(60) for k in (1, 2) if i + k < 60]
    got, many = nodes(run(spark, pairs, block=4)), len(seen)
    assert got == nodes(run(spark, pairs))
    # Numbering, and two supersteps in either direction.
    assert many < 14
