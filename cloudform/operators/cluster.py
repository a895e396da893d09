"""Clustering of profiles and its evaluation. Profiles are few (one for each entity), so linkage runs in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from .cloud import column_matrix


def linked(d: np.ndarray, k: int, method: str) -> np.ndarray:
    """Labels 0..k-1 of agglomerative clustering of a distance matrix: ward, average or complete."""
    d = (d.astype(float) ** 2 if method == "ward" else d.astype(float)).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - max(k, 1)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        a, b = size[i], size[j]
        if method == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        elif method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.maximum(d[i], d[j])
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j], size[i] = False, a + b
        label[label == label[j]] = label[i]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def kmeans(x: np.ndarray, k: int, seed: int = 0, restarts: int = 50) -> np.ndarray:
    best, out = np.inf, None
    for r in range(restarts):
        rng = np.random.default_rng((seed, r))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(100):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            y = d.argmin(1)
            new = np.array([x[y == i].mean(0) if (y == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best:
            best, out = cost, y
    return out


def adjusted_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1), int)
    np.add.at(table, (a, b), 1)
    n, ra, rb = table.sum(), table.sum(1), table.sum(0)
    nz = table > 0
    mi = (table[nz] / n * np.log(n * table[nz] / np.outer(ra, rb)[nz])).sum()
    ha, hb = (-(r[r > 0] / n * np.log(r[r > 0] / n)).sum() for r in (ra, rb))
    lg, want = math.lgamma, 0.0
    for x in ra:
        for y in rb:
            for t in range(max(1, x + y - n), min(x, y) + 1):
                p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(t + 1) - lg(x - t + 1) - lg(y - t + 1) - lg(n - x - y + t + 1)
                want += t / n * math.log(n * t / (x * y)) * math.exp(p)
    top = (ha + hb) / 2 - want
    return 1.0 if abs(top) < 1e-15 else float((mi - want) / top)


def assign(profiles: DataFrame, id_: str, vector: str, k: int, method: str) -> DataFrame:
    """Cluster labels of one small table of profile vectors, by size: 1 is the largest."""
    kind = profiles.schema[id_].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(id_, "ascending")])
        x = np.array(group.column(vector).to_pylist(), float)
        y = kmeans(x, k) if method == "kmeans" else linked(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), min(k, len(x)), method)
        return pa.table({id_: group.column(id_), "raw": pa.array(y.astype(np.int32))})

    raw = profiles.select(id_, vector, F.lit(0).alias("one")).groupBy("one").applyInArrow(run, f"{id_} {kind}, raw int")
    return relabelled(raw, id_, "raw")


def relabelled(df: DataFrame, id_: str, label: str) -> DataFrame:
    """Labels 1, 2, ... by falling size, then by the label as text."""
    sizes = df.groupBy(label).count().withColumn("cluster", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col(label).cast("string"))))  # a row for each cluster
    return df.join(sizes, label).select(id_, "cluster")


BLOCK = 1 << 14  # points of a chunk
WIDE = 1 << 20  # components of a chunk
SLICE = 128  # points of one chunk that are compared with the other at once


def _distances(x: np.ndarray, y: np.ndarray, squares: np.ndarray) -> np.ndarray:
    d2 = x @ y.T
    d2 *= -2
    d2 += (x**2).sum(1)[:, None]
    d2 += squares
    r, k = np.nonzero(d2 < 1e-6 * (squares + 1))  # products lose digits there
    for i in range(0, len(r), 1 << 16):
        p, q = r[i : i + (1 << 16)], k[i : i + (1 << 16)]
        d2[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0, out=d2), out=d2)


def _members(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(at), n))
    out[np.arange(len(at)), at] = 1
    return out


def _gaps(group: pa.Table) -> pa.Table:
    """Of one block: for each point and cluster, the sum of the distances to the other chunk's points and their number.

    Distances of two chunks serve the points of both. One id stands in one chunk, so it meets itself within a chunk alone.
    """
    ids, c, chunk, x = group.column("id").to_numpy(), group.column("c").to_numpy(), group.column("chunk").to_numpy(), column_matrix(group, "x")
    row, col = (group.column(k)[0].as_py() for k in ("row", "col"))
    kinds, at = np.unique(c, return_inverse=True)
    q, o = np.flatnonzero(chunk == row), np.flatnonzero(chunk == col)
    y, member = x[o], _members(at[o], len(kinds))
    squares, back, count = (y**2).sum(1), np.zeros((len(o), len(kinds))), np.tile(member.sum(0), (SLICE, 1))
    out = [(ids[:0], c[:0], c[:0], np.zeros(0), np.zeros(0, np.int64))]

    def add(some, total, n):
        r, k = np.nonzero(n > 0)
        out.append((ids[some[r]], c[some[r]], kinds[k], total[r, k], n[r, k].astype(np.int64)))

    for i in range(0, len(q), SLICE):
        some = q[i : i + SLICE]
        d, n = _distances(x[some], y, squares), count[: len(some)]
        if row == col:
            same = ids[some][:, None] == ids[o]
            d[same] = 0
            n = n - same.astype(float) @ member
        else:
            back += d.T @ _members(at[some], len(kinds))
        add(some, d @ member, n)
    if row != col:
        add(o, back, np.tile(_members(at[q], len(kinds)).sum(0), (len(o), 1)))
    return pa.table(dict(zip(("id", "own", "other", "total", "n"), (np.concatenate(v) for v in zip(*out, strict=True)), strict=True)))


def dealt(rows: DataFrame) -> DataFrame:
    """rows(id, c, x) in each block of two chunks that their chunk takes part in."""
    side = rows.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("x")) / WIDE)).cast("int").alias("side"))  # one row
    own = rows.crossJoin(F.broadcast(side)).withColumn("chunk", F.pmod(F.xxhash64("id"), "side").cast("int"))
    return own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).select("id", "c", "x", "chunk", F.least("chunk", "o").alias("row"), F.greatest("chunk", "o").alias("col"))


def silhouettes(points: DataFrame, id_: str, cluster: str, vector: str) -> DataFrame:
    """Euclidean silhouette of each point; 0 in clusters of one.

    All pairs are compared in blocks of two chunks of BLOCK points or WIDE components, which hand on sums by cluster and no
    pairs: a point is copied as many times as there are chunks.
    """
    rows = points.select(F.col(id_).cast("long").alias("id"), F.col(cluster).cast("long").alias("c"), F.col(vector).alias("x"))
    sums = dealt(rows).groupBy("row", "col").applyInArrow(_gaps, "id long, own long, other long, total double, n long")
    mean = sums.groupBy("id", "own", "other").agg((F.sum("total") / F.sum("n")).alias("d"))
    out = mean.groupBy("id", "own").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("b"))
    kinds = {f.name: f.dataType for f in points.schema.fields}
    return out.select(F.col("id").cast(kinds[id_]).alias(id_), F.col("own").cast(kinds[cluster]).alias(cluster), F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index from the contingency table."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    t = contingency(df, a, b)
    both = t.agg(two("n").alias("both"), F.sum("n").alias("all"))
    left = t.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("left"))
    right = t.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("right"))
    one = both.crossJoin(left).crossJoin(right)  # one row each
    want = F.col("left") * F.col("right") / (F.col("all") * (F.col("all") - 1) / 2)
    return one.select(ratio(F.col("both") - want, (F.col("left") + F.col("right")) / 2 - want).alias("ari"))


def purity(df: DataFrame, cluster: str, domain: str) -> DataFrame:
    most = contingency(df, cluster, domain).groupBy(cluster).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return most.agg((F.sum("most") / F.sum("n")).alias("purity"))


def composition(df: DataFrame, cluster: str, domain: str) -> DataFrame:
    t = contingency(df, cluster, domain)
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))
