"""Maps of groups of vectors in the plane, of all their rows, and how well they keep neighbourhoods. Small groups are mapped in one task each, large ones by all tasks together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from . import together
from .cloud import column_matrix
from .models import gaps

METHODS = ("pca", "mds", "isomap", "tsne")


def fixed_signs(y: np.ndarray) -> np.ndarray:
    return y * np.where(y[np.abs(y).argmax(0), np.arange(y.shape[1])] < 0, -1, 1)


def two_columns(y: np.ndarray) -> np.ndarray:
    return np.pad(y, ((0, 0), (0, max(0, 2 - y.shape[1]))))[:, :2]


def pca(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    return fixed_signs(two_columns(c @ axes[:2].T))


def mds(d: np.ndarray) -> np.ndarray:
    """Classical scaling of a matrix of distances."""
    c = np.eye(len(d)) - 1 / len(d)
    w, v = np.linalg.eigh(-0.5 * c @ d**2 @ c)
    return fixed_signs(two_columns(v[:, ::-1][:, :2] * np.sqrt(np.maximum(w[::-1][:2], 0))))


def isomap(d: np.ndarray, k: int = 10) -> np.ndarray:
    """Classical scaling of the lengths of shortest ways in the graph of the k nearest; parts are joined by their shortest edge."""
    n = len(d)
    way = np.full((n, n), np.inf)
    by = np.argsort(d, axis=1, kind="stable")[:, : min(k + 1, n)]
    np.put_along_axis(way, by, np.take_along_axis(d, by, 1), 1)
    way = np.minimum(way, way.T)
    for m in range(n):
        way = np.minimum(way, way[:, m, None] + way[None, m])
    while np.isinf(way).any():
        i, j = np.unravel_index(np.argmin(np.where(np.isinf(way), d, np.inf)), d.shape)
        way = np.minimum(way, np.minimum(way[:, i, None] + d[i, j] + way[None, j], way[:, j, None] + d[i, j] + way[None, i]))
    return mds(way)


def affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric probabilities of neighbours, each row's width found by halving so that its perplexity is as wanted."""
    n = len(d2)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / np.maximum(np.median(d2, 1), 1e-12)
    off = ~np.eye(n, dtype=bool)
    least = np.where(off, d2, np.inf).min(1, keepdims=True)
    for _ in range(60):
        p = np.exp(np.where(off, -(d2 - least) * beta[:, None], -np.inf))
        total = p.sum(1)
        p /= total[:, None]
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return np.maximum((p + p.T) / (2 * n), 1e-12)


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 500, rate: float = 200.0) -> np.ndarray:
    """t-distributed neighbour embedding, all pairs, from the principal plane."""
    n = len(x)
    if n < 5:
        return pca(x)
    p = affinities(gaps(x) ** 2, min(perplexity, (n - 1) / 3))
    y = pca(x)
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4
    move, gain = np.zeros_like(y), np.ones_like(y)
    for i in range(rounds):
        w = 1 / (1 + gaps(y) ** 2)
        np.fill_diagonal(w, 0)
        f = (p * (12 if i < 100 else 1) - np.maximum(w / w.sum(), 1e-12)) * w
        grad = 4 * (f.sum(1)[:, None] * y - f @ y)
        gain = np.maximum(np.where(grad * move > 0, gain * 0.8, gain + 0.2), 0.01)
        move = (0.5 if i < 100 else 0.8) * move - min(rate, n / 3 + 10) * gain * grad
        y = y + move
        y -= y.mean(0)
    return y


def mapped(x: np.ndarray, method: str) -> np.ndarray:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return {"pca": pca, "mds": lambda v: mds(gaps(v)), "isomap": lambda v: isomap(gaps(v)), "tsne": tsne}[method](x) if len(x) > 1 else np.zeros((len(x), 2))


def trustworthiness(d: np.ndarray, y: np.ndarray, k: int = 5) -> float | None:
    """1 less the ranks by which neighbours in the map are too far apart in the distances d; NULL for too few points."""
    n = len(d)
    k = min(k, (n - 1) // 2)
    if k < 1 or 2 * n - 3 * k - 1 <= 0:
        return None
    e = gaps(y)
    rank = np.empty((n, n), int)
    far = d.copy()
    np.fill_diagonal(far, -1)
    np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.arange(n)[None].repeat(n, 0), 1)
    np.fill_diagonal(e, np.inf)
    near = np.argsort(e, axis=1, kind="stable")[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over)


def projections(rows: DataFrame, group: str, id_: str, vector: str, methods: tuple[str, ...] = METHODS, *, alone: int = 500, batch: int = together.BATCH) -> DataFrame:
    """(group, method, id, x, y, n, trustworthiness) of each group's map by each method, of all its rows.

    A group of at most `alone` rows is mapped in one task; larger ones by all tasks together, in batches of groups. Each
    batch is one barrier stage, so dynamic allocation must be off, and the folder for tables must be one pyarrow can open.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}; of {', '.join(METHODS)}")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = f"{group} {kinds[group]}, method string, {id_} {kinds[id_]}, x double, y double, n long, trustworthiness double"

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([(id_, "ascending")])
        x = column_matrix(t, "v")
        y = mapped(x, key[1].as_py())
        many = len(x)
        trust = trustworthiness(gaps(x), y) if many > 1 else None
        return pa.table({group: t.column(group), "method": t.column("method"), id_: t.column(id_), "x": y[:, 0], "y": y[:, 1], "n": [many] * many, "trustworthiness": pa.array([trust] * many, pa.float64())})

    def small(some: DataFrame) -> DataFrame:
        return some.select(group, id_, F.col(vector).alias("v"), F.explode(F.array(*map(F.lit, methods))).alias("method")).groupBy(group, "method").applyInArrow(run, shape)

    large = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > alone).select(group, "n").sort(F.desc("n"), group).collect()
    if not large:
        return small(rows)
    spark = rows.sparkSession
    keys = spark.createDataFrame([(r[0], g) for g, r in enumerate(large)], T.StructType([T.StructField("_of", rows.schema[group].dataType), T.StructField("_at", T.IntegerType())]))
    is_of = F.col(group).eqNullSafe(F.col("_of"))
    out = small(rows.join(F.broadcast(keys), is_of, "left_anti"))
    for places in together.batches([r.n for r in large], batch):
        one = keys.where(F.col("_at").isin(places))
        some = written(rows.join(F.broadcast(one), is_of).select(F.col("_at").alias("g"), F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")))
        made = written(together.stage(some, kinds[id_], methods, pca, fixed_signs))
        out = out.unionByName(made.join(F.broadcast(one), F.col("g") == F.col("_at")).select(F.col("_of").alias(group), "method", F.col("id").alias(id_), "x", "y", "n", "trustworthiness"))
    return out


def with_coordinates(rows: DataFrame, coordinates: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """rows with x and y by id, in a fixed order of columns; columns that rows lack are NULL."""
    out = rows.join(coordinates.select(id_, "x", "y"), id_, "left")
    return out.select(id_, *((F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)) for c in columns if c != id_), "x", "y")
