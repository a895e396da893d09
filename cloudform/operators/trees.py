"""Minimum spanning trees of groups of vectors, and density clusters from the tree's hierarchy, for groups of any size.

The tree: rounds of Boruvka over a grid of blocks of two chunks of vectors, compared piece by piece. A block gives the least edge that leaves each
component it sees, Spark takes the least of all blocks, and components that edges join get one name by pointer jumping.
Exact; each round compares all pairs of a group but those of pieces that lie in one component.

The hierarchy: the edges of each group are numbered by length and climbed range by range. What a range leaves of a group
is a row for each component (size, open cluster, sums), so a task holds one range's edges and the components they touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .cloud import column_matrix
from .entities import numbered

CHUNK = 8192  # vectors of a chunk; each vector travels once for each chunk of its group
PIECE = 2048  # vectors of a block's side that are compared at once; a matrix has 32 MB
RANGE = 1 << 16  # edges of a group that a task climbs at once
LEAST = 1e-9  # shorter edges count as this long, so that the density of equal vectors is a number


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """Vectors of rows(g, id, u) in each block of their group's grid that their chunk takes part in."""
    sides = rows.groupBy("g").agg(F.ceil(F.count("*") / chunk).cast("int").alias("side"))
    own = rows.join(sides, "g").withColumn("chunk", F.pmod(F.xxhash64("id"), "side").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    return own.select("g", "id", "u", "chunk", F.least("chunk", "other").alias("row"), F.greatest("chunk", "other").alias("col"))


def _pieces(t: pa.Table, size: int, comp: np.ndarray | None = None):
    """Places of vectors of both chunks of a block, piece by piece, and the distances between them; infinite for one and the same.

    Each pair of different vectors is in one piece. Pieces that lie in one component are left out.
    """
    chunk, x = t.column("chunk").to_numpy(), column_matrix(t, "u")
    row, col = (t.column(c)[0].as_py() for c in ("row", "col"))
    rows, cols = np.flatnonzero(chunk == row), np.flatnonzero(chunk == col)
    for i in range(0, len(rows), size):
        for j in range(i if row == col else 0, len(cols), size):
            p, q = rows[i : i + size], cols[j : j + size]
            if comp is not None and (comp[p] == comp[p[0]]).all() and (comp[q] == comp[p[0]]).all():
                continue
            a, b = x[p], x[q]
            d = a @ b.T
            d *= -2
            d += (a**2).sum(1)[:, None]
            d += (b**2).sum(1)[None]
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            if row == col and i == j:
                d = np.maximum(d, d.T)  # both ways the same number
                np.fill_diagonal(d, np.inf)
                yield p, q, d, ((p, q, d),)
            else:
                yield p, q, d, ((p, q, d), (q, p, d.T))


def core_distances(rows: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(g, id, core) of rows(g, id, u): the distance to the k-th other vector of the group, or to the last if there are fewer."""

    piece = PIECE

    def run(t: pa.Table) -> pa.Table:
        ids, out, val = t.column("id").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, _, _, ways in _pieces(t, piece):
            for at, _, m in ways:
                best = np.partition(m, min(k, m.shape[1]) - 1, axis=1)[:, :k]
                out.append(np.repeat(ids[at], best.shape[1]))
                val.append(best.ravel())
        out, val = np.concatenate(out), np.concatenate(val)
        by = np.lexsort((val, out))
        by = by[np.isfinite(val[by])]
        start = np.flatnonzero(np.diff(out[by], prepend=out[by][:1] - 1))
        by = by[np.arange(len(by)) - np.repeat(start, np.diff(start, append=len(by))) < k]  # the k least of each
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * len(by), pa.string()), "id": out[by], "d": val[by]})

    found = _dealt(rows, chunk).groupBy("g", "row", "col").applyInArrow(run, "g string, id long, d double")
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("g", "id").orderBy("d"))).where(F.col("rank") <= k)
    return near.groupBy("g", "id").agg(F.max("d").alias("core"))


def _outgoing(size: int):
    """The least edge out of each component of a block by (length, lower id, higher id)."""

    def run(t: pa.Table) -> pa.Table:
        comp = t.column("c").to_numpy()
        none = np.zeros(0, np.int64)
        c, w, a, b = [none], [np.zeros(0)], [none], [none]
        if (comp != comp[0]).any():
            ids, core = t.column("id").to_numpy(), t.column("core").to_numpy()
            for p, q, d, ways in _pieces(t, size, comp):
                np.maximum(d, core[p][:, None], out=d)
                np.maximum(d, core[q][None], out=d)
                d[comp[p][:, None] == comp[q][None]] = np.inf
                for at, to, m in ways:
                    low = m.min(1)
                    i, j = np.nonzero((m == low[:, None]) & np.isfinite(low)[:, None])
                    c.append(comp[at[i]])
                    w.append(m[i, j])
                    a.append(np.minimum(ids[at[i]], ids[to[j]]))
                    b.append(np.maximum(ids[at[i]], ids[to[j]]))
                c, w, a, b = _least(c, w, a, b)
        c, w, a, b = map(np.concatenate, (c, w, a, b))
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * len(c), pa.string()), "c": c, "w": w, "a": a, "b": b})

    return run


def _least(*parts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Of edges (component, length, lower id, higher id) the least of each component."""
    c, w, a, b = map(np.concatenate, parts)
    by = np.lexsort((b, a, w, c))
    by = by[np.concatenate([[True], c[by][1:] != c[by][:-1]])] if len(by) else by
    return [[v[by]] for v in (c, w, a, b)]


def _roots(links: DataFrame) -> DataFrame:
    """(g, c, root) of links(g, c, to), each of a component to the one its least edge leads to.

    Edges have a total order, so the only circles are two components that chose one another; the lower one is the root.
    """
    back = links.select("g", F.col("c").alias("to"), F.col("to").alias("back"))
    up = written(links.join(back, ["g", "to"], "left").select("g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")))
    while True:
        over = up.select("g", F.col("c").alias("root"), F.col("root").alias("over"))
        new = written(up.join(over, ["g", "root"], "left").select("g", "c", F.coalesce("over", "root").alias("root"), (F.col("over") != F.col("root")).alias("moved")))
        up = new.select("g", "c", "root")
        if not new.where("moved").limit(1).count():
            return up


def _tree(rows: DataFrame, cores: DataFrame, chunk: int) -> DataFrame:
    points = written(_dealt(rows, chunk).join(cores, ["g", "id"]))
    comps = written(rows.select("g", "id", F.col("id").alias("c")))
    edges = None
    while True:
        found = points.join(comps, ["g", "id"]).groupBy("g", "row", "col").applyInArrow(_outgoing(PIECE), "g string, c long, w double, a long, b long")
        least = written(found.groupBy("g", "c").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("g", "c", "e.*"))
        if not least.limit(1).count():
            return edges if edges is not None else least.select("g", "a", "b", "w")
        ends = least.select("g", "c", F.explode(F.array("a", "b")).alias("id")).join(comps.withColumnRenamed("c", "to"), ["g", "id"]).where("c <> to")
        up = _roots(ends.select("g", "c", "to"))
        new = least.select("g", "a", "b", "w").distinct()
        edges = written(new if edges is None else edges.union(new))
        comps = written(comps.join(up, ["g", "c"], "left").select("g", "id", F.coalesce("root", "c").alias("c")))


def _usable(rows: DataFrame, group: str, id_: str, vector: str) -> DataFrame:
    good = F.col(group).isNotNull() & F.col(id_).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    return written(rows.where(good).select(F.col(group).cast("string").alias("g"), F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("u")))


def spanning_tree(rows: DataFrame, group: str, id_: str, vector: str, *, k: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(group, a, b, w): the minimum spanning tree of each group by Euclidean distance, a < b, ties by ids.

    With k > 0 by mutual reachability: an edge is at least as long as the distance of each end to its k-th other vector.
    Rows without a group, an id or a vector of numbers are left out; ids are whole numbers and do not repeat in a group.
    A group of one vector has no edge.
    """
    own = _usable(rows, group, id_, vector)
    cores = core_distances(own, k, chunk) if k else own.select("g", "id", F.lit(0.0).alias("core"))
    return _tree(own, cores, chunk).select(F.col("g").cast(rows.schema[group].dataType).alias(group), "a", "b", "w")


# ---------------------------------------------------------------- the hierarchy of a tree
STATE = ("size", "open", "total", "inner")
CLIMBED = "g string, kind string, node long, root long, first long, size long, open long, total double, inner double, parent long, wins boolean"


def _climb(least: int):
    """Joins the components of one range of edges of a group from the shortest edge on.

    A component of at least `least` vectors is an open cluster; its vectors add the density (1 / length) at which they
    came. Where two open clusters meet both close: the sum less the vectors times the density at the end is a cluster's
    stability, and it wins unless the clusters within it are worth more together.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending")])
        col = {c: t.column(c).to_pylist() for c in t.schema.names}
        top: dict[int, int] = {}
        state: dict[int, list] = {}
        loose: dict[int, list[int]] = {}
        first: dict[int, int] = {}
        closed = []
        for s in "ab":
            for node, *values in zip(col["n" + s], *(col[f"{c}_{s}"] for c in STATE), strict=True):
                top[node], state[node], loose[node] = node, values, [] if values[1] is not None else [node]

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for place, na, nb, w in zip(col["place"], col["na"], col["nb"], col["w"], strict=True):
            a, b, dense = find(na), find(nb), 1 / max(w, LEAST)
            if (state[a][0], -a) < (state[b][0], -b):
                a, b = b, a
            big, small = state[a], state[b]
            size = big[0] + small[0]
            if big[1] is not None and small[1] is not None:
                worth = 0.0
                for n, cluster, total, inner in (big, small):
                    stable = total - n * dense
                    closed.append((cluster, place, stable >= inner))
                    worth += max(stable, inner)
                state[a] = [size, place, size * dense, worth]
            elif big[1] is not None:
                first.update(dict.fromkeys(loose[b], big[1]))
                state[a] = [size, big[1], big[2] + small[0] * dense, big[3]]
            elif size >= least:
                first.update(dict.fromkeys(loose[a] + loose[b], place))
                state[a], loose[a] = [size, place, size * dense, 0.0], []
            else:
                state[a], loose[a] = [size, None, 0.0, 0.0], loose[a] + loose[b]
            top[b] = a
        nodes = list(top)
        up = [find(n) for n in nodes]
        n, m = len(nodes), len(closed)
        ends = [state[r] for r in up]
        return pa.table({
            "g": pa.array([col["g"][0]] * (n + m), pa.string()), "kind": pa.array(["node"] * n + ["cluster"] * m, pa.string()),
            "node": pa.array(nodes + [c for c, _, _ in closed], pa.int64()), "root": pa.array(up + [None] * m, pa.int64()),
            "first": pa.array([first.get(x) for x in nodes] + [None] * m, pa.int64()),
            **{c: pa.array([e[i] for e in ends] + [None] * m, kind) for i, (c, kind) in enumerate(zip(STATE, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))},
            "parent": pa.array([None] * n + [p for _, p, _ in closed], pa.int64()), "wins": pa.array([None] * n + [x for _, _, x in closed], pa.bool_()),
        })

    return run


def _placed(edges: DataFrame) -> DataFrame:
    """edges with their place in their group by (w, a, b), from 0."""
    n = written(numbered(edges.withColumn("edge", F.struct("g", "a", "b")), ["g", "w"], "edge", "place").drop("edge"))
    low = n.groupBy("g").agg(F.min("place").alias("low"))
    return written(n.join(low, "g").withColumn("place", F.col("place") - F.col("low")).drop("low"))


def _winners(clusters: DataFrame) -> DataFrame:
    """(g, cluster, label): the outermost winner that each cluster lies in or is; by doubling steps towards the root."""
    now = written(clusters.select("g", "cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("label")))
    while now.where("up is not null").limit(1).count():
        over = now.select("g", F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("label").alias("label2"))
        now = written(now.join(over, ["g", "up"], "left").select("g", "cluster", F.col("up2").alias("up"), F.coalesce("label2", "label").alias("label")))
    return now.select("g", "cluster", "label")


def tree_clusters(ids: DataFrame, edges: DataFrame, least: int, *, size: int = RANGE) -> DataFrame:
    """(g, id, label) of ids(g, id) from the spanning trees edges(g, a, b, w): the most stable clusters of the hierarchy.

    label is the smallest id of the cluster, NULL for vectors of none. A group's outermost cluster is no answer, so a
    group without a split into two clusters of at least `least` vectors has none.
    """
    placed = _placed(edges)
    last = placed.agg(F.max("place").alias("m")).first().m
    members = written(ids.select("g", "id", F.col("id").alias("node"), F.lit(None).cast("long").alias("first")))
    alone = [F.lit(1).cast("long"), F.lit(None).cast("long"), F.lit(0.0), F.lit(0.0)]
    if least <= 1:
        raise ValueError("a cluster has two vectors at least")
    state = ids.select("g", F.col("id").alias("node"), *(v.alias(c) for v, c in zip(alone, STATE, strict=True)))
    clusters = ids.sparkSession.createDataFrame([], "g string, cluster long, parent long, wins boolean")
    for r in range(0 if last is None else last // size + 1):
        some = placed.where((F.col("place") >= r * size) & (F.col("place") < (r + 1) * size))
        for s in "ab":
            some = some.join(members.select("g", F.col("id").alias(s), F.col("node").alias("n" + s)), ["g", s])
            some = some.join(state.select("g", F.col("node").alias("n" + s), *(F.col(c).alias(f"{c}_{s}") for c in STATE)), ["g", "n" + s])
        out = written(some.drop("a", "b").groupBy("g").applyInArrow(_climb(least), CLIMBED))
        nodes = out.where("kind = 'node'")
        moved = nodes.select("g", "node", "root", F.col("first").alias("now"))
        members = written(members.join(moved, ["g", "node"], "left").select("g", "id", F.coalesce("root", "node").alias("node"), F.coalesce("first", "now").alias("first")))
        kept = state.join(nodes.select("g", "node"), ["g", "node"], "left_anti")
        state = written(kept.unionByName(nodes.where("node = root").select("g", "node", *STATE)))
        clusters = clusters.unionByName(out.where("kind = 'cluster'").select("g", F.col("node").alias("cluster"), "parent", "wins"))
    outer = state.where("open is not null").select("g", F.col("open").alias("cluster"), F.lit(None).cast("long").alias("parent"), F.lit(False).alias("wins"))
    labels = _winners(clusters.unionByName(outer)).withColumnRenamed("cluster", "first")
    found = written(members.join(labels, ["g", "first"], "left").select("g", "id", "label"))
    names = found.where("label is not null").groupBy("g", "label").agg(F.min("id").alias("name"))
    return found.join(names, ["g", "label"], "left").select("g", "id", F.col("name").alias("label"))


def density_clusters(rows: DataFrame, group: str, id_: str, vector: str, *, least: int = 5, k: int | None = None, chunk: int = CHUNK, size: int = RANGE) -> DataFrame:
    """(group, id, label): density clusters of at least `least` vectors in each group, by mutual reachability over k others.

    k is `least` where none is given. label is the smallest id of the cluster, NULL for vectors in none (all, in a group
    without two clusters). Rows without a group, an id or a vector of numbers are left out; an empty table has no rows.
    """
    own = _usable(rows, group, id_, vector)
    edges = _tree(own, core_distances(own, least if k is None else k, chunk), chunk) if own.limit(1).count() else own.select("g", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    out = tree_clusters(own.select("g", "id"), edges, least, size=size)
    return out.select(F.col("g").cast(rows.schema[group].dataType).alias(group), F.col("id").alias(id_), "label")
