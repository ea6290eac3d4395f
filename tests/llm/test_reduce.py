import random

from canopy.llm import reduce


def brute(edges):
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def solve(spark, edges):
    rows = reduce.consolidate(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["v"])
    assert len({r["v"] for r in rows}) == len(rows)
    return sorted(map(sorted, groups.values()))


SHAPES = {
    "chain": [(i, i + 1) for i in range(40)],
    "ring": [(i, (i + 1) % 17) for i in range(17)],
    "two rings that share a vertex": [(i, (i + 1) % 5) for i in range(5)] + [(0, 10), (10, 11), (11, 0)],
    "star": [(0, i) for i in range(1, 50)],
    "tree": [(i, 2 * i + 1) for i in range(30)] + [(i, 2 * i + 2) for i in range(30)],
    "core with chains": [(a, b) for a in range(5) for b in range(a)] + [(0, 20), (20, 21), (21, 22), (4, 30), (30, 31), (31, 3)],
    "lone edge, loop, nulls, repeats": [(7, 3), (3, 7), (7, 3), (5, 5), (None, 1), (2, None)],
    "nothing": [],
}


def apart(graphs):
    """The graphs side by side in one, so that all are solved in the same rounds."""
    move = lambda x, k: None if x is None else x + 1000 * k
    return [(move(a, k), move(b, k)) for k, g in enumerate(graphs) for a, b in g]


def test_shapes(spark):
    edges = apart(SHAPES.values())
    assert solve(spark, edges) == brute(edges)
    assert solve(spark, []) == []


def test_random_graphs(spark):
    graphs = []
    for seed, n, m in [(1, 40, 35), (2, 30, 45), (3, 25, 80)]:
        rng = random.Random(seed)
        graphs.append([(rng.randrange(n), rng.randrange(n)) for _ in range(m)])
    edges = apart(graphs)
    assert solve(spark, edges) == brute(edges)


def test_many_stages_make_no_large_plan(spark, monkeypatch):
    tree = [(i, j) for i in range(2**15 - 1) for j in (2 * i + 1, 2 * i + 2)]
    caterpillar = [(10**6 + a, 10**6 + b) for a, b in [(i, i + 1) for i in range(14)] + [(i, 100 * (i + 1) + k) for i in range(15) for k in range(3)]]
    edges = tree + caterpillar
    joins, write = [], reduce.cut

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df)

    monkeypatch.setattr(reduce, "cut", counted)
    rows = reduce.consolidate(spark.createDataFrame(edges, "a long, b long"))
    assert rows.count() == len(edges) + 2 and rows.select("root").distinct().count() == 2
    assert max(joins) <= 2


def test_works(spark):
    works = spark.createDataFrame(
        [(1, "L1", ["doi:10.1/A", "", None, "x:"]), (2, "L2", ["DOI:10.1/a"]), (3, "L1", None), (4, "L4", ["x:", ""]), (5, "L5", []), (6, None, ["y:1"]), (7, " ", ["Y:1 "]), (8, None, None), (9, " ", None)],
        "work_id long, label string, ids array<string>",
    )
    pairs = spark.createDataFrame([("L5", "L4", 1), ("L4", "L4", 2), ("L2", "gone", 3), ("gone", "L5", 4), (None, "L1", 5)], "label_a string, label_b string, work_id int")
    got = sorted(tuple(r) for r in reduce.group_works(works, pairs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert reduce.group_works(works.limit(0), pairs.limit(0)).count() == 0
