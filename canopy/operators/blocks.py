"""Iterations over graphs that are cut into blocks of vertices.

Vertices are numbered in the order of their ids and cut into ranges; a block holds a range
and the arcs that leave it. A task holds neighbouring blocks. In a superstep every task
works on what it holds to its end in numpy, and what crosses tasks is added up per target
and shuffled to the next superstep. So a path costs a superstep only where it changes
tasks, and where ids follow time, as those of catalogues do, citations change them rarely.
A block has about BLOCK arcs: vertices with more than HOT arcs become trees of virtual
vertices with negative numbers, and ranges of too many arcs are cut once more. The number
of blocks follows the size of the graph; there is no other way for small or large graphs.
Where arcs are done with on the way, what is left is shared again by as few tasks as hold
BLOCK arcs each, so the last BLOCK arcs of any graph are one task's. Rows between
supersteps lie in the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from canopy.session import cut, cut_by, ship

#: Parameters: arcs of a block, and arcs of a vertex beyond which it is split.
BLOCK, HOT = 250_000, 50_000
#: Vertices of a range have numbers from range << RANGE on; virtual ones of a vertex.
RANGE, VIRTUAL = 33, 4096
#: Parameter: frames that a pile holds before they are written as one.
PILE = 16


class Pile:
    """Rows that come in many frames; the plan never has more than PILE of them."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.frames.append(df)
        if len(self.frames) > PILE:
            self.frames = [cut(reduce(DataFrame.unionByName, self.frames))]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.frames)


@dataclass
class Numbered:
    """names (id, n, o0, o1: arcs that end and start there) in `ranges` ranges; arcs (s, t, step, ...),
    of which those within a split vertex have step 0; sub: the ranges that were cut once more;
    tasks: how many tasks share the blocks; split: whether there are virtual vertices;
    shares: the task of each range, where they aren't shared evenly."""

    names: DataFrame
    arcs: DataFrame
    ranges: int
    tasks: int
    sub: DataFrame | None = None
    split: bool = False
    shares: tuple[int, ...] = ()

    def turned(self) -> Numbered:
        """The graph with every arc in the other direction."""
        names = self.names.select("id", "n", F.col("o1").alias("o0"), F.col("o0").alias("o1"))
        arcs = self.arcs.select(F.col("t").alias("s"), F.col("s").alias("t"), *[c for c in self.arcs.columns if c not in ("s", "t")])
        return replace(self, names=names, arcs=arcs)

    def ids(self, df: DataFrame, *columns: str) -> DataFrame:
        """`df` with the ids in place of numbers; rows of virtual vertices fall out."""
        for c in columns:
            df = df.join(self.names.select(F.col("n").alias(c), F.col("id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
        return df

    def starts(self) -> DataFrame:
        """(n, o0, o1): how many of the arcs end and start in each vertex, virtual ones too."""
        return arc_ends(self.arcs, self.names) if self.split else self.names.select("n", "o0", "o1")

    def numbers(self, df: DataFrame, c: str) -> DataFrame:
        return df.join(self.names.select(F.col("id").alias(c), F.col("n").alias("_n")), c).drop(c).withColumnRenamed("_n", c)

    @staticmethod
    def range_of(n: str) -> Column:
        """The range of the vertex in column n; a virtual one is in the range of its vertex."""
        return F.shiftright(F.expr(f"if({n} >= 0, {n}, (-{n} - 1) div {2 * VIRTUAL})"), RANGE)

    def placed(self, df: DataFrame, n: str, task: str) -> DataFrame:
        """`df` with the task of the vertex in column n: neighbouring ranges share one, parts of a range are spread."""
        range_ = self.range_of(n)
        if self.shares:
            at = F.get(F.split(F.lit(" ".join(map(str, self.shares))), " "), range_.cast("int")).cast("long")
        else:
            at = F.floor(range_ * self.tasks / self.ranges)
        if self.sub is None:
            return df.withColumn(task, at)
        # A row per range that was cut once more; there are no more ranges than the parameter BLOCK makes.
        sub = F.broadcast(self.sub.select(F.col("range").alias("_r"), F.col("parts").alias("_p")))
        joined = df.withColumn("_range", range_).withColumn(task, at).join(sub, F.col("_range") == F.col("_r"), "left")
        part = F.when(F.col("_p").isNotNull(), F.pmod(F.xxhash64(n), F.col("_p")) + 1).otherwise(F.lit(0))
        return joined.withColumn(task, (F.col(task) + part) % self.tasks).drop("_range", "_r", "_p")

    def ended(self, arcs: DataFrame) -> DataFrame:
        """`arcs` with the tasks of both ends as task and tt."""
        return self.placed(self.placed(arcs, "s", "task"), "t", "tt")

    def shared(self, left: DataFrame) -> Numbered:
        """The graph in as few tasks as hold BLOCK arcs each of those that are left, m at the vertices n."""
        # A row per range, as above.
        per, many = left.groupBy(self.range_of("n").alias("range")).agg(F.sum("m").alias("m")).collect(), np.zeros(self.ranges)
        for r in per:
            many[r["range"]] = r["m"]
        tasks = max(1, -(-int(many.sum()) // BLOCK))
        at = (np.cumsum(many) - many / 2) * tasks // max(many.sum(), 1)
        return replace(self, tasks=tasks, shares=tuple(np.minimum(at, tasks - 1).astype(int).tolist()))


def arc_ends(arcs: DataFrame, names: DataFrame) -> DataFrame:
    """(n, o0, o1) over any arcs; names (n) without arcs have none."""
    ends = arcs.select(F.col("t").alias("n"), F.lit(1).alias("o0"), F.lit(0).alias("o1")).union(arcs.select("s", F.lit(0), F.lit(1))).union(names.select("n", F.lit(0), F.lit(0)))
    return ends.groupBy("n").agg(F.sum("o0").alias("o0"), F.sum("o1").alias("o1"))


def numbered(edges: DataFrame, vertices: DataFrame | None = None, block: int | None = None) -> Numbered:
    """Numbers for the ends of written edges (src, dst, ...) and for further vertices (id); block:
    arcs of a block in place of BLOCK, with HOT smaller in proportion. A task holds no more than
    about BLOCK arcs; smaller blocks are shared by as many tasks as there are cores, at least."""
    ship(edges.sparkSession)
    size, block = edges.count(), block or BLOCK
    hot = max(2, HOT * block // BLOCK)
    ranges = max(1, -(-size // block))
    tasks = max(1, -(-size // max(block, BLOCK)), min(ranges, edges.sparkSession.sparkContext.defaultParallelism))
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("o0"), F.lit(0).alias("o1")).union(edges.select("src", F.lit(0), F.lit(1)))
    if vertices is not None:
        ends = ends.union(vertices.select("id", F.lit(0), F.lit(0)))
    counted = ends.where("id is not null").groupBy("id").agg(F.sum("o0").alias("o0"), F.sum("o1").alias("o1"))
    names = cut(counted.repartitionByRange(ranges, "id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("n"), "o0", "o1").coalesce(tasks))
    found = Numbered(names, edges, ranges, tasks)
    found.arcs = found.numbers(found.numbers(edges.withColumnsRenamed({"src": "s", "dst": "t"}), "s"), "t").withColumn("step", F.lit(1))
    per = names.groupBy(F.shiftright("n", RANGE).alias("range")).agg(F.sum("o1").alias("m"), F.greatest(F.max("o0"), F.max("o1")).alias("d"))
    most, hottest = per.agg(F.max("m"), F.max("d")).first()
    if hottest is not None and hottest > hot:
        found.arcs = cut(_split(_split(cut(found.arcs), "s", "t", hot), "t", "s", hot))
        found.split = True
    if most is not None and most > 2 * block:
        found.sub = cut(per.where(F.col("m") > 2 * block).select("range", F.ceil(F.col("m") / block).alias("parts")))
    return found


def _split(arcs: DataFrame, end: str, other: str, most: int) -> DataFrame:
    """Arcs in which a vertex with more than `most` of them at `end` has virtual vertices between."""
    hot = arcs.groupBy(end).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > most).select(end, F.least(F.ceil(F.col("_m") / most), F.lit(VIRTUAL)).alias("_k"))
    virtual = -(F.col(end) * (2 * VIRTUAL) + (VIRTUAL if end == "t" else 0) + F.pmod(F.xxhash64(other), F.col("_k")) + 1)
    marked = cut(arcs.join(hot, end, "left").withColumn("_v", F.when(F.col("_k").isNotNull(), virtual)))
    leaves = marked.withColumn(end, F.coalesce("_v", end)).drop("_v", "_k")
    rest = {c: F.lit(0).cast(t) for c, t in arcs.dtypes if c not in ("s", "t")}
    trunk = marked.where("_v is not null").select(F.col(end), F.col("_v").alias(other)).distinct().withColumns(rest)
    return leaves.unionByName(trunk.select(*leaves.columns))


def _supersteps(graph: Numbered, arcs: DataFrame, rows: DataFrame, state, schema: str, done: int | None = None, left: str | None = None, enough: int = -1) -> tuple[DataFrame, DataFrame | None, int]:
    """(kept rows, done rows, number of kept rows): supersteps on the arcs and rows of a task,
    which are kept as state(task, rows, arcs), until none sends a row.

    rows have kind (0: kept, 1: sent, `done`: not needed any more, 3: kept and not worked on
    yet) and what `schema` says but the task. From the second superstep on the arcs lie
    partitioned by task. left: how many arcs a kept row has that are still needed, those of
    other rows being done with; as they become fewer, so do tasks, and with `enough` of them
    or fewer it ends.
    """
    parts = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), graph.tasks)
    names, kinds = [c.split()[0] for c in schema.split(", ")], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def work(arcs: pa.Table, rows: pa.Table) -> pa.Table:
        tables = [pa.table({c: pa.array(x[c]) for c in names}).cast(target) for x in _worked(state, _columns(arcs), _columns(rows))]
        return pa.concat_tables(tables) if tables else target.empty_table()

    open_ = F.sum(F.expr(f"if(kind = 0, {left}, 0)")) if left else F.sum(F.lit(0))
    placed, rows, pile, held = graph.ended(arcs), graph.placed(rows, "n", "task").select(*names), Pile(), None
    while True:
        seen = Observation()
        out = placed.groupBy("task").cogroup(rows.groupBy("task")).applyInArrow(work, schema)
        rows = cut(out.observe(seen, F.count_if(F.col("kind") == 0).alias("kept"), F.count_if(F.col("kind") == 1).alias("sent"), open_.alias("open")))
        if done is not None:
            pile.add(rows.where(F.col("kind") == done))
            rows = rows.where(F.col("kind") != done)
        still = seen.get["open"] or 0
        if not seen.get["sent"] or left and still <= enough:
            return rows.where("kind = 0"), pile.all() if done is not None else None, seen.get["kept"]
        if left and (held is None or 2 * still <= held):
            kept = rows.where("kind = 0")
            graph = graph.shared(kept.select("n", F.expr(left).alias("m")))
            placed = graph.ended(placed.drop("task", "tt").join(kept.select(F.col("n").alias("s")), "s", "left_semi"))
            rows = graph.placed(rows.drop("task"), "n", "task").select(*names)
            placed, held = cut_by(placed, parts, "task"), still
        elif held is None:
            placed, held = cut_by(placed, parts, "task"), still


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t[c].to_numpy() for c in t.column_names}


def _cut_at(cols: dict[str, np.ndarray], sorted_: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
    keys, first = np.unique(sorted_, return_index=True)
    ends = [*first[1:].tolist(), len(sorted_)]
    return {k: {c: x[i:j] for c, x in cols.items()} for k, i, j in zip(keys.tolist(), first.tolist(), ends)}


def _joined(many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return many[0] if len(many) == 1 else {c: np.concatenate([x[c] for x in many]) for c in many[0]}


def _worked(state, arcs: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
    """What a task keeps and what it sends to other tasks; without news it keeps its rows as they are."""
    sent = rows["kind"] == 1
    if not sent.any() and not (rows["kind"] == 3).any():
        return [rows] if len(sent) else []
    here = state(int(rows["task"][0]), {c: x[~sent] for c, x in rows.items()}, arcs)
    to = here.take({c: x[sent] for c, x in rows.items()} if sent.any() else None)
    return [here.rows(), to]


class _Block:
    """Arcs that leave the vertices `ids` (sorted) of a task, ordered by source."""

    def __init__(self, ids: np.ndarray, arcs: dict[str, np.ndarray]):
        self.ids, n = ids, len(ids)
        s = self.at(arcs["s"])
        use = np.flatnonzero(s < n)
        use = use[np.argsort(s[use], kind="stable")]
        self.s, self.arc = s[use], {c: x[use] for c, x in arcs.items() if c != "s"}
        self.first = np.searchsorted(self.s, np.arange(n + 1))
        inner = self.arc["tt"] == self.arc["task"]
        # Targets: a place in ids, n for a vertex of this task that isn't there, -1 in other tasks.
        self.t = np.where(inner, self.at(self.arc["t"]), -1)

    def at(self, numbers: np.ndarray) -> np.ndarray:
        """Places of numbers in ids; the number of ids for those that aren't there."""
        n = len(self.ids)
        if not n:
            return np.zeros(len(numbers), np.int64)
        found = np.searchsorted(self.ids, numbers)
        found[found == n] = 0
        return np.where(self.ids[found] == numbers, found, n)

    def out_of(self, front: np.ndarray) -> np.ndarray:
        """The places of all arcs that leave the vertices `front`."""
        many = self.first[front + 1] - self.first[front]
        start = np.repeat(self.first[front] - np.cumsum(many) + many, many)
        return start + np.arange(many.sum())


def _numbers(t: pa.Table, *columns: str) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in columns]


class _Peeling:
    """The vertices of a task that aren't peeled yet; see peel()."""

    def __init__(self, values: list[str], either: bool):
        self.values, self.either = values, either

    def __call__(self, task: int, rows: dict, arcs: dict) -> _Peeling:
        new, order = _Peeling(self.values, self.either), np.argsort(rows["n"])
        new.task, new.b, size = task, _Block(rows["n"][order], arcs), len(order)
        new.open, new.level = np.stack([rows["o0"][order], rows["o1"][order]]), rows["level"][order]
        new.sums, new.gone = [rows[v][order] for v in self.values], np.zeros(size, bool)
        new.front = np.arange(size) if (rows["kind"] == 3).any() else np.zeros(0, np.int64)
        return new

    def free(self, at: np.ndarray) -> np.ndarray:
        return ~self.gone[at] & ((self.open[0, at] == 0) | (self.open[1, at] == 0) if self.either else self.open[0, at] == 0)

    def take(self, sent: dict | None) -> dict[str, np.ndarray]:
        b, open_, lv, away = self.b, self.open, self.level, []
        front, self.front = self.front, np.zeros(0, np.int64)
        if sent:
            to = b.at(sent["n"])
            use = np.flatnonzero(to < len(b.ids))
            to = to[use]
            np.subtract.at(open_[0], to, sent["o0"][use])
            np.subtract.at(open_[1], to, sent["o1"][use])
            np.maximum.at(lv, to, sent["level"][use])
            for total, v in zip(self.sums, self.values):
                np.add.at(total, to, sent[v][use])
            front = np.union1d(front, to)
        front = front[self.free(front)]
        while len(front):
            self.gone[front] = True
            out = b.out_of(front)
            away.append(out[b.t[out] == -1])
            out = out[(b.t[out] >= 0) & (b.t[out] < len(b.ids))]
            s, t = b.s[out], b.t[out]
            np.subtract.at(open_, (b.arc["slot"][out], t), 1)
            np.maximum.at(lv, t, (lv[s] + b.arc["step"][out]).astype(lv.dtype))
            for total in self.sums:
                np.add.at(total, t, total[s])
            t = np.unique(t)
            front = t[self.free(t)]
        out = np.concatenate(away) if away else np.zeros(0, np.int64)
        s, slot = b.s[out], b.arc["slot"][out]
        return self.merged({"task": b.arc["tt"][out], "n": b.arc["t"][out], "o0": slot == 0, "o1": slot == 1, "level": lv[s] + b.arc["step"][out], **{v: total[s] for v, total in zip(self.values, self.sums)}})

    def merged(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """What is sent to a vertex, as one row."""
        to, first, place = np.unique(x["n"], return_index=True, return_inverse=True)
        add = lambda c: np.bincount(place, x[c], len(to))
        most = np.zeros(len(to), np.int64)
        np.maximum.at(most, place, x["level"])
        return {"task": x["task"][first], "kind": np.ones(len(to), np.int64), "n": to, "o0": add("o0").astype(np.int64), "o1": add("o1").astype(np.int64), "level": most, **{v: add(v) for v in self.values}}

    def rows(self) -> dict[str, np.ndarray]:
        size = len(self.b.ids)
        return {"task": np.full(size, self.task), "kind": np.where(self.gone, 2, 0), "n": self.b.ids, "o0": self.open[0], "o1": self.open[1], "level": self.level, **dict(zip(self.values, self.sums))}


def peel(graph: Numbered, arcs: DataFrame, starts: DataFrame, values: list[str], either: bool = False, enough: int = -1) -> tuple[DataFrame, DataFrame, int]:
    """(peeled, left, size of left): peeled (n, level, values) of vertices whose arcs have all been paid.

    starts: n, o0, o1 and values. A vertex is free when its count o0 of open arcs is zero
    (either: or o1 is); it then pays what it points at by one in the arc's slot, raises
    their level to its own and the arc's step, and adds its values to theirs. Each arc is
    walked once. left (n): what lies on or behind cycles. enough: with so many open arcs it
    ends early, and left has what would have been peeled later.
    """
    schema = "task long, kind int, n long, o0 long, o1 long, level int" + "".join(f", {v} double" for v in values)
    rows = starts.withColumn("kind", F.lit(3)).withColumn("level", F.lit(0))
    open_ = "(o0 + o1) / 2" if either else "o1"
    left, gone, size = _supersteps(graph, arcs.select("s", "t", "step", "slot"), rows, _Peeling(values, either), schema, 2, open_, enough)
    return gone.select("n", "level", *values), left.select("n"), size


class _Relaxing:
    """What is known in a task, as places and distances of each source; see relax()."""

    def __call__(self, task: int, rows: dict, arcs: dict) -> _Relaxing:
        new = _Relaxing()
        new.task, new.arcs, new.known = task, arcs, {}
        ends = [arcs["s"], arcs["t"][arcs["tt"] == arcs["task"]]]
        new.b = _Block(np.unique(np.concatenate([*ends, rows["n"]])), arcs)
        at, order = new.b.at(rows["n"]), np.argsort(rows["source"], kind="stable")
        for source, x in _cut_at({"at": at[order], "d": rows["d"][order]}, rows["source"][order]).items():
            new.known[source] = x["at"], x["d"]
        return new

    def take(self, sent: dict) -> dict[str, np.ndarray]:
        if (self.b.at(sent["n"]) == len(self.b.ids)).any():
            before = self.b.ids
            self.b = _Block(np.union1d(before, sent["n"]), self.arcs)
            moved = self.b.at(before)
            self.known = {source: (moved[at], d) for source, (at, d) in self.known.items()}
        b, order, away = self.b, np.argsort(sent["source"], kind="stable"), []
        weight = b.arc["w"]
        for source, x in _cut_at({"at": b.at(sent["n"])[order], "d": sent["d"][order]}, sent["source"][order]).items():
            dist = np.full(len(b.ids), np.inf)
            if source in self.known:
                dist[self.known[source][0]] = self.known[source][1]
            known = dist.copy()
            np.minimum.at(dist, x["at"], x["d"])
            front = np.flatnonzero(dist < known)
            while len(front):
                out = b.out_of(front)
                out = out[b.t[out] >= 0]
                before = dist[b.t[out]]
                np.minimum.at(dist, b.t[out], dist[b.s[out]] + weight[out])
                front = np.unique(b.t[out][dist[b.t[out]] < before])
            out = b.out_of(np.flatnonzero(dist < known))
            out = out[b.t[out] == -1]
            away.append({"task": b.arc["tt"][out], "source": np.full(len(out), source), "n": b.arc["t"][out], "d": dist[b.s[out]] + weight[out]})
            have = np.flatnonzero(np.isfinite(dist))
            self.known[source] = have, dist[have]
        return self.merged(_joined(away))

    @staticmethod
    def merged(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """What is sent to a vertex from a source, as one row."""
        order = np.lexsort((x["d"], x["n"], x["source"]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(x["source"][order]) != 0) | (np.diff(x["n"][order]) != 0)
        order = order[new]
        return {"kind": np.ones(len(order), np.int64), **{c: v[order] for c, v in x.items() if c != "kind"}}

    def rows(self) -> dict[str, np.ndarray]:
        parts = [(np.full(len(at), source), self.b.ids[at], d) for source, (at, d) in self.known.items()]
        source, n, d = (np.concatenate(x) for x in zip(*parts))
        return {"task": np.full(len(n), self.task), "kind": np.zeros(len(n), np.int64), "source": source, "n": n, "d": d}


def relax(graph: Numbered, arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """(source, n, d): the least d that reaches a vertex from the starts (source, n, d) of its
    source, where an arc adds its w of 0 or more."""
    schema = "task long, kind int, source long, n long, d double"
    kept, _, _ = _supersteps(graph, arcs.select("s", "t", F.col("w").cast("double").alias("w")), starts.withColumn("kind", F.lit(1)), _Relaxing(), schema)
    return kept.select("source", "n", "d")


def _cycles(s: np.ndarray, t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, the largest member of their component) of strong components of two or more."""
    alive = np.ones(len(s), bool)
    while True:
        into, out = np.zeros(size, bool), np.zeros(size, bool)
        into[t[alive]], out[s[alive]] = True, True
        left = alive & into[s] & out[t]
        if left.sum() == alive.sum():
            break
        alive = left
    s, t = s[alive], t[alive]
    order = np.argsort(s, kind="stable")
    first, targets = np.searchsorted(s[order], np.arange(size + 1)).tolist(), t[order].tolist()
    # One search in depth; low is the earliest vertex on the stack that a vertex leads back to.
    seen, low, stack, on = {}, {}, [], {}
    members, largest = [], []
    for root in np.unique(s).tolist():
        if root in seen:
            continue
        path = [(root, first[root])]
        while path:
            v, i = path.pop()
            if v not in seen:
                seen[v] = low[v] = len(seen)
                on[v] = len(stack)
                stack.append(v)
            elif i > first[v] and targets[i - 1] in on:
                low[v] = min(low[v], low[targets[i - 1]])
            while i < first[v + 1]:
                u = targets[i]
                i += 1
                if u not in seen:
                    path += [(v, i), (u, first[u])]
                    break
                if u in on:
                    low[v] = min(low[v], seen[u])
            else:
                if low[v] == seen[v]:
                    own = stack[on[v] :]
                    del stack[on[v] :]
                    for u in own:
                        del on[u]
                    if len(own) > 1:
                        members += own
                        largest += [max(own)] * len(own)
    return np.array(members, np.int64), np.array(largest, np.int64)


def _named_cycles(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _cycles() of arcs between any numbers."""
    ids, codes = np.unique(np.concatenate([s, t]), return_inverse=True)
    members, largest = _cycles(codes[: len(s)], codes[len(s) :], len(ids))
    return ids[members], ids[largest]


def inner_components(graph: Numbered, arcs: DataFrame) -> tuple[DataFrame, int]:
    """((n, c), crossing): strong components of two or more within each task, called by their
    largest vertex, and the number of arcs between tasks."""

    def work(arcs: pa.Table) -> pa.Table:
        s, t, task, tt = _numbers(arcs, "s", "t", "task", "tt")
        members, largest = _named_cycles(s[task == tt], t[task == tt])
        return pa.table({"n": pa.array(members, pa.int64()), "c": pa.array(largest, pa.int64())})

    seen = Observation()
    placed = graph.ended(arcs.select("s", "t")).observe(seen, F.count_if(F.col("task") != F.col("tt")).alias("crossing"))
    found = cut(placed.groupBy("task").applyInArrow(work, "n long, c long"))
    return found, seen.get["crossing"]


def whole_components(arcs: DataFrame) -> DataFrame:
    """(n, c): strong components of two or more vertices that aren't virtual, of no more than BLOCK arcs in one task."""

    def work(arcs: pa.Table) -> pa.Table:
        members, largest = _named_cycles(*_numbers(arcs, "s", "t"))
        members, largest = members[members >= 0], largest[members >= 0]
        _, at, many = np.unique(largest, return_inverse=True, return_counts=True)
        use = many[at] > 1
        return pa.table({"n": pa.array(members[use], pa.int64()), "c": pa.array(largest[use], pa.int64())})

    return cut(arcs.select("s", "t").groupBy().applyInArrow(work, "n long, c long"))
