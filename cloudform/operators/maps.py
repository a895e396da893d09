"""Maps of groups of any size in the plane, from the table of nearest neighbours.

neighbour_map: the neighbours' fuzzy graph is laid out by attraction along sampled edges and repulsion from sampled
vertices. Vertices are dealt anew in each round over a grid of blocks; a cell of two blocks holds their vertices and the
edges between them, takes some epochs of its own, and the moves of all cells are summed into the next table of
positions. diffusion_map: a random walk on the neighbour graph, taken between landmarks of a bounded number, whose
log-probabilities are laid out by scaling; every other vertex stands at the mean of the landmarks its first step leads to.
A cell and the landmarks of a group have a bounded size; no other task sees more than its share of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import dot, matrices
from ..sources.scratch import written
from .cloud import HAND, column_matrix, moments, whole_matrix

BLOCK = 1 << 14  # vertices of a block
CHUNK = 2048  # vectors that are compared with the landmarks at once
LANDMARKS = 1000


def curve(least: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b) closest to a closeness of 1 up to `least` that decays beyond it. Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want, p = np.where(x < least, 1.0, np.exp(-(x - least) / spread)), np.array([1.0, 1.0])
    for _ in range(100):
        u = p[0] * x ** (2 * p[1])
        f = 1 / (1 + u)
        jac = -(f**2 * u)[:, None] * np.stack([np.full(len(x), 1 / p[0]), 2 * np.log(x)], 1)
        p = np.maximum(p + np.linalg.solve(jac.T @ jac + 1e-6 * np.eye(2), jac.T @ (want - f)), 1e-3)
    return float(p[0]), float(p[1])


@F.arrow_udf(returnType=T.DoubleType())
def _width(lists: pa.Array) -> pa.Array:
    """For each list of distances the width s for which the sum of exp(-(d - least positive) / s) is log2 of the count, itself included."""
    out = np.ones(len(lists))
    for rows, d in matrices(lists):
        over = np.maximum(d - np.where(d > 0, d, np.inf).min(1, initial=np.inf, keepdims=True), 0)
        over = np.where(np.isfinite(over), over, 0)
        low, high, s = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _ in range(64):
            wide = np.exp(-over / s[:, None]).sum(1) > np.log2(d.shape[1] + 1)
            low, high = np.where(wide, low, s), np.where(wide, s, high)
            s = np.where(np.isinf(high), s * 2, (low + high) / 2)
        out[rows] = np.maximum(s, 1e-3 * np.maximum(d.mean(1), 1e-12))
    return pa.array(out)


def fuzzy_edges(near: DataFrame, group: str) -> DataFrame:
    """(group, a, b, w), a < b: how surely two vertices are neighbours, from each one's own scale; w = p + q - p q."""
    own = near.groupBy(group, "src").agg(F.sort_array(F.collect_list(F.struct("d", "dst"))).alias("near"))  # k at most
    d = F.transform("near", lambda x: x.d)
    own = own.select(group, "src", "near", F.coalesce(F.array_min(F.filter(d, lambda x: x > 0)), F.lit(0.0)).alias("rho"), _width(d).alias("s"))
    one = own.select(group, "src", "rho", "s", F.explode("near").alias("x"))
    one = one.select(group, F.least("src", "x.dst").alias("a"), F.greatest("src", "x.dst").alias("b"), F.exp(-F.greatest(F.col("x.d") - F.col("rho"), F.lit(0.0)) / F.col("s")).alias("p"))
    both = one.groupBy(group, "a", "b").agg(F.sum("p").alias("t"), F.max("p").alias("p"))
    return both.select(group, "a", "b", F.least(F.col("t") - F.col("p") * (F.col("t") - F.col("p")), F.lit(1.0)).alias("w"))


def principal_plane(rows: DataFrame, group: str, id_: str, sizes: DataFrame) -> DataFrame:
    """(group, id, x, y): each vector on the two first principal axes of its group, whose largest entries are positive."""

    def run(t: pa.Table) -> pa.Table:
        n, s, ss = whole_matrix(t)
        axes = np.linalg.eigh(ss / n - np.outer(s, s) / n**2)[1][:, ::-1][:, :2].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        axes = np.vstack([axes, np.zeros((2 - len(axes), len(s)))])
        return pa.table({"g": pa.array([t.column("g")[0].as_py()], pa.string()), "one": [axes[0]], "two": [axes[1]], "c1": [axes[0] @ s / n], "c2": [axes[1] @ s / n]})

    many = sizes.limit(HAND + 1).count() > HAND
    axes = written(moments(rows, F.col(group), "u", deal=many).groupBy("g").applyInArrow(run, "g string, one array<double>, two array<double>, c1 double, c2 double"))
    axes = axes.withColumnRenamed("g", "_g")
    return rows.join(axes, F.col(group).cast("string") == F.col("_g")).select(group, id_, (dot("u", "one") - F.col("c1")).alias("x"), (dot("u", "two") - F.col("c2")).alias("y"))


def _layout(a: float, b: float, epochs: int, negatives: int, seed: int, done: float, step: float):
    """Moves of the vertices of one cell after some epochs; done and step: the part of all epochs before, and of one."""

    def run(key: tuple[pa.Scalar, ...], points: pa.Table, edges: pa.Table) -> pa.Table:
        points = points.sort_by("id")
        ids, start = points.column("id").to_numpy(), np.stack([points.column(c).to_numpy() for c in "xy"], 1)
        edges = edges.sort_by([("a", "ascending"), ("b", "ascending")])
        i, j, w = (edges.column(c).to_numpy() for c in "abw")
        i, j, y, n = np.searchsorted(ids, i), np.searchsorted(ids, j), start.copy(), len(ids)
        rng = np.random.default_rng((seed, key[1].as_py(), key[2].as_py(), int(done * 1e6)))

        def moved(at, force):
            return np.stack([np.bincount(at, force[:, c], n) for c in (0, 1)], 1)

        for e in range(epochs if len(w) and n > 1 else 0):
            rate = max(1 - done - step * e, 0.0)
            some = rng.random(len(w)) < w
            p, q = i[some], j[some]
            gap = y[p] - y[q]
            d2 = (gap**2).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
            pull = np.clip(pull[:, None] * gap, -4, 4)
            force = moved(p, pull) - moved(q, pull)
            ends = np.repeat(np.concatenate([p, q]), negatives)
            others = rng.integers(0, n, len(ends))
            gap = y[ends] - y[others]
            d2 = (gap**2).sum(1)
            push = np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * gap, -4, 4) * (ends != others)[:, None]
            y += rate * np.clip(force + moved(ends, push), -4, 4)
        return pa.table({"g": points.column("g"), "id": ids, "x": y[:, 0] - start[:, 0], "y": y[:, 1] - start[:, 1]})

    return run


def neighbour_map(rows: DataFrame, near: DataFrame, group: str, id_: str, *, rounds: int = 20, epochs: int = 10, least: float = 0.1, spread: float = 1.0, negatives: int = 5, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(group, id, x, y) of all unit rows(group, id, u) from near(group, src, dst, d); ids are integers, distinct in a group.

    A round is one job: a group of n vertices makes a grid of n / block blocks, so a vertex is copied so many times. A
    vertex without neighbours only keeps its place in the principal plane. Null groups are left out.
    """
    rows = rows.where(F.col(group).isNotNull())
    sizes = written(rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.ceil(F.count("*") / block).alias("side")))
    a, b = curve(least, spread)
    edges = fuzzy_edges(near, group).select(F.col(group).cast("string").alias("g"), "a", "b", "w").join(sizes, "g")
    edges = written(edges.select("g", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w", "side"))
    start = principal_plane(rows, group, id_, sizes).select(F.col(group).cast("string").alias("g"), F.col(id_).cast("long").alias("id"), "x", "y")
    start = written(start)
    wide = start.groupBy("g").agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("most"))
    jitter = lambda k: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(2001)) - 1000) * 1e-6  # noqa: E731  no two vertices stand in one place
    scaled = lambda c, k: (F.col(c) * 10 / F.greatest("most", F.lit(1e-12)) + jitter(k)).alias(c)
    at = written(start.join(wide, "g").select("g", "id", scaled("x", seed), scaled("y", seed + 1)))
    for r in range(rounds):
        place = lambda c: F.pmod(F.xxhash64(F.lit(seed * 1000 + r), c), "side").cast("int")  # noqa: E731, B023
        mine = at.join(sizes, "g").withColumn("one", place("id")).withColumn("two", F.explode(F.sequence(F.lit(0), F.col("side").cast("int") - 1)))
        mine = mine.select("g", F.least("one", "two").alias("i"), F.greatest("one", "two").alias("j"), "id", "x", "y")
        ends = edges.select("g", F.least(place("a"), place("b")).alias("i"), F.greatest(place("a"), place("b")).alias("j"), "a", "b", "w")
        run = _layout(a, b, epochs, negatives, seed, r / rounds, 1 / (rounds * epochs))
        moves = mine.groupBy("g", "i", "j").cogroup(ends.groupBy("g", "i", "j")).applyInArrow(run, "g string, id long, x double, y double")
        at = written(at.unionByName(moves).groupBy("g", "id").agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
    kinds = rows.schema
    return at.select(F.col("g").cast(kinds[group].dataType).alias(group), F.col("id").cast(kinds[id_].dataType).alias(id_), "x", "y")


# ---------------------------------------------------------------- diffusion
def _nearest_landmark(key: tuple[pa.Scalar, ...], points: pa.Table, marks: pa.Table) -> pa.Table:
    marks = marks.sort_by("id")
    best = (column_matrix(points, "u") @ column_matrix(marks, "u").T).argmax(1)
    return pa.table({"g": points.column("g"), "id": points.column("id"), "mark": marks.column("id").take(pa.array(best))})


def _scaled(power: int | None):
    """Points of a group's landmarks from their walk p(one, two): log-probabilities after some steps, by scaling."""

    def run(t: pa.Table) -> pa.Table:
        ids = np.unique(t.column("one").to_numpy())
        p = np.zeros((len(ids),) * 2)
        p[np.searchsorted(ids, t.column("one").to_numpy()), np.searchsorted(ids, t.column("two").to_numpy())] = t.column("p").to_numpy()
        steps = power
        if steps is None:  # where the entropy of the walk's spectrum bends
            s = np.linalg.svd(p, compute_uv=False)
            part = [s**k / max((s**k).sum(), 1e-300) for k in range(1, 101)]
            h = np.array([-(v[v > 1e-12] * np.log(v[v > 1e-12])).sum() for v in part])
            line = h[0] + (h[-1] - h[0]) * np.arange(len(h)) / (len(h) - 1)
            steps = int((line - h).argmax()) + 1
        u = -np.log(np.linalg.matrix_power(p, steps) + 1e-7)
        d2 = np.maximum((u**2).sum(1)[:, None] + (u**2).sum(1)[None] - 2 * u @ u.T, 0)
        np.fill_diagonal(d2, 0)
        d = np.sqrt(d2)
        c = d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean()
        w, v = np.linalg.eigh(-0.5 * c)
        y = v[:, ::-1][:, :2] * np.sqrt(np.maximum(w[::-1][:2], 0))
        y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
        y = y * np.where(y[np.abs(y).argmax(0), np.arange(2)] < 0, -1, 1)
        n = len(ids)
        for _ in range(100):  # majorisation from the classical solution
            e = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T, 0))
            ratio = np.where(e > 1e-12, d / np.maximum(e, 1e-12), 0)
            z = (np.diag(ratio.sum(1)) - ratio) @ y / n
            if np.abs(z - y).max() < 1e-6 * max(np.abs(y).max(), 1e-12):
                break
            y = z
        return pa.table({"g": pa.array([t.column("g")[0].as_py()] * n, pa.string()), "mark": ids, "x": y[:, 0], "y": y[:, 1], "steps": np.full(n, steps, np.int32)})

    return run


def walk(near: DataFrame, group: str, decay: float) -> DataFrame:
    """(g, src, dst, k) both ways and with itself: affinities that decay with the distance over that of the last neighbour."""
    d = F.sqrt(2 * F.col("d"))
    far = F.max(d).over(Window.partitionBy("g", "src"))  # k rows
    one = near.select(F.col(group).cast("string").alias("g"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "d")
    one = one.withColumn("k", F.when(far > 1e-12, F.exp(-F.pow(d / F.greatest(far, F.lit(1e-12)), F.lit(decay)))).otherwise(1.0) / 2)
    return one.select("g", "src", "dst", "k").unionByName(one.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "k")).groupBy("g", "src", "dst").agg(F.sum("k").alias("k"))


def diffusion_map(rows: DataFrame, near: DataFrame, group: str, id_: str, *, landmarks: int = LANDMARKS, decay: float = 40.0, power: int | None = None, seed: int = 0) -> DataFrame:
    """(group, id, x, y) of all unit rows(group, id, u) from near(group, src, dst, d); ids are integers, distinct in a group.

    Landmarks are the `landmarks` rows of a group whose hashed ids are smallest; each vertex belongs to the nearest of
    them. The walk between landmarks, their table times itself by a join, has landmarks² entries a group at most. Without
    `power` each group takes as many steps as its spectrum asks for. Null groups are left out.
    """
    some = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(id_).cast("long").alias("id"), "u")
    h = F.xxhash64(F.lit(seed), "id")
    # A bound of the hash under which each group has somewhat more rows than it needs, then the smallest of those.
    n = written(some.groupBy("g").agg(F.count("*").alias("n")))
    share = (F.col("n") - 2 * landmarks) / F.col("n")
    draw = F.when(share <= 0, F.lit(True)).otherwise(F.pmod(h, F.lit(1 << 30)) < (1 - share) * (1 << 30))
    w = Window.partitionBy("g").orderBy("h", "id")  # about twice the landmarks of each group
    marks = some.join(n, "g").where(draw).withColumn("h", F.pmod(h, F.lit(1 << 30))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= landmarks).select("g", "id", "u")
    marks = written(marks)

    chunks = n.select("g", F.ceil(F.col("n") / CHUNK).cast("int").alias("side"))
    dealt = some.join(chunks, "g").select("g", "id", "u", F.pmod(F.xxhash64("id"), "side").cast("int").alias("chunk"))
    copies = marks.join(chunks, "g").select("g", "id", "u", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("chunk"))
    home = written(dealt.groupBy("g", "chunk").cogroup(copies.groupBy("g", "chunk")).applyInArrow(_nearest_landmark, "g string, id long, mark long"))

    itself = home.select("g", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("k"))
    edges = walk(near, group, decay).unionByName(itself)
    to = edges.join(home.select("g", F.col("id").alias("dst"), "mark"), ["g", "dst"]).groupBy("g", "src", "mark").agg(F.sum("k").alias("k"))
    to = written(to)  # of each vertex, the affinity to each landmark's vertices
    out = to.join(to.groupBy("g", "src").agg(F.sum("k").alias("t")), ["g", "src"]).select("g", "src", "mark", (F.col("k") / F.col("t")).alias("p"))
    back = to.join(to.groupBy("g", "mark").agg(F.sum("k").alias("t")), ["g", "mark"]).select("g", "src", F.col("mark").alias("one"), (F.col("k") / F.col("t")).alias("q"))
    between = back.join(out.withColumnRenamed("mark", "two"), ["g", "src"]).groupBy("g", "one", "two").agg(F.sum(F.col("q") * F.col("p")).alias("p"))
    points = written(between.groupBy("g").applyInArrow(_scaled(power), "g string, mark long, x double, y double, steps int"))
    mean = lambda c: F.sum(F.col("p") * F.col(c)).alias(c)
    placed = out.join(points, ["g", "mark"]).groupBy("g", "src").agg(mean("x"), mean("y"))
    return placed.select(F.col("g").cast(rows.schema[group].dataType).alias(group), F.col("src").cast(rows.schema[id_].dataType).alias(id_), "x", "y")
