"""k-means and Gaussian mixtures over tables of any size: a model of fixed size on the driver, statistics summed by task.

A pass sends the model to the tasks, each sums what its rows say about every cluster, and Spark adds the sums up; no
group and no constant key brings the rows together. Seeding samples about 2 k rows in each of a few passes, in
proportion to their squared distance to what is chosen, and picks k of them on the driver by their weights.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import matrices
from ..sources.scratch import written

STEP = 4096  # rows of a task that are compared with the clusters at once


class Mixture(NamedTuple):
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray


def _pieces(batch: pa.RecordBatch, name: str):
    for rows, x in matrices(batch.column(batch.schema.get_field_index(name))):
        for a in range(0, len(rows), STEP):
            yield rows[a : a + STEP], x[a : a + STEP]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def _summed(points: DataFrame, part: Callable[[np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums, by key, of part(x) over all pieces of the vectors: a row for each key comes to the driver."""

    def run(frames):
        sums: dict = {}
        for batch in frames:
            for _, x in _pieces(batch, "x"):
                for k, v in part(x).items():
                    sums[k] = sums.get(k, 0) + v
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": [np.asarray(v, float).ravel()]})

    parts = points.select("x").mapInArrow(run, "k int, v array<double>")
    return {r.k: np.array(r.v) for r in parts.groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()}


def _cost(points: DataFrame, c: np.ndarray) -> float:
    return float(_summed(points, lambda x: {0: np.array([squares(x, c).min(1).sum()])})[0][0])


def _weighted_start(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of weighted rows, each next one drawn in proportion to its weight and squared distance to those before."""
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    while len(chosen) < min(k, len(x)):
        odds = w * squares(x, x[chosen]).min(1)
        odds[chosen] = 0
        if odds.sum() <= 0:
            odds = np.where(np.isin(np.arange(len(x)), chosen), 0.0, 1.0)
        chosen.append(int(rng.choice(len(x), p=odds / odds.sum())))
    return x[chosen]


def seeds(points: DataFrame, k: int, seed: int = 0, passes: int = 4) -> np.ndarray:
    """At most k rows of points(id, x) as a start. Reruns agree: what is drawn depends on ids alone."""
    luck = lambda p: (F.pmod(F.xxhash64(F.lit(seed), F.lit(p), "id"), F.lit(1 << 52)) + 1) / float(1 << 52)
    c = np.array([points.orderBy(luck(0), "id").select("x").first().x])
    for p in range(1, passes + 1):
        total, now = _cost(points, c), c
        if total <= 0:
            break

        def run(frames, total=total, now=now):
            for batch in frames:
                luck_, id_ = (batch.column(batch.schema.get_field_index(n)) for n in ("luck", "id"))
                for rows, x in _pieces(batch, "x"):
                    hit = rows[luck_.to_numpy()[rows] * total < 2 * k * squares(x, now).min(1)]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([id_.take(pa.array(hit)), batch.column(batch.schema.get_field_index("x")).take(pa.array(hit))], ["id", "x"])

        kind = points.schema["id"].dataType.simpleString()
        more = points.select("id", "x", luck(p).alias("luck")).mapInArrow(run, f"id {kind}, x array<double>").orderBy("id").collect()  # about 2 k rows
        c = np.concatenate([c, np.array([r.x for r in more]).reshape(-1, c.shape[1])])
    c = np.unique(c, axis=0)
    weight = _summed(points, lambda x: {0: np.bincount(squares(x, c).argmin(1), minlength=len(c)).astype(float)})[0]
    return _weighted_start(c, np.maximum(weight, 1e-9), k, np.random.default_rng(seed))


def lloyds(points: DataFrame, starts: list[np.ndarray], rounds: int = 100, tolerance: float = 1e-9) -> list[tuple[np.ndarray, float]]:
    """Centres of points(x) and the sum of squared distances to them, from each start. One pass a round serves all that still move.

    A centre that loses all rows stays where it is.
    """
    c, moving, wide = list(starts), list(range(len(starts))), max(map(len, starts))
    for _ in range(rounds):
        now = {r: c[r] for r in moving}

        def part(x, now=now):
            one, out = np.hstack([np.ones((len(x), 1)), x]), {}
            for r, centres in now.items():
                y = squares(x, centres).argmin(1)
                out |= {r * wide + int(j): one[y == j].sum(0) for j in np.unique(y)}
            return out

        got, moving = _summed(points, part), []
        for r in now:
            new = c[r].copy()
            for j in range(len(new)):
                if (v := got.get(r * wide + j)) is not None:
                    new[j] = v[1:] / v[0]
            if np.abs(new - c[r]).max() > tolerance * max(np.abs(new).max(), 1e-300):
                moving.append(r)
            c[r] = new
        if not moving:
            break
    cost = _summed(points, lambda x: {r: np.array([squares(x, centres).min(1).sum()]) for r, centres in enumerate(c)})
    return [(centres, float(cost[r][0])) for r, centres in enumerate(c)]


def lloyd(points: DataFrame, start: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    return lloyds(points, [start], rounds, tolerance)[0]


def _usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    good = F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    return written(rows.where(good).select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("x")))


def _labelled(points: DataFrame, kind: str, columns: str, label: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    def run(frames):
        for batch in frames:
            id_ = batch.column(batch.schema.get_field_index("id"))
            for rows, x in _pieces(batch, "x"):
                yield pa.RecordBatch.from_pydict({"id": id_.take(pa.array(rows))} | label(x))

    return points.select("id", "x").mapInArrow(run, f"id {kind}, {columns}")


def kmeans_clusters(rows: DataFrame, id_: str, vector: str, k: int, *, start: np.ndarray | None = None, rounds: int = 100, restarts: int = 1, seed: int = 0) -> DataFrame:
    """id, cluster (from 0) and squared distance to its centre of each row whose vector has numbers only, of one length.

    The best of some restarts by the sum of squared distances. An empty table has no rows.
    """
    points = _usable(rows, id_, vector)
    kind = rows.schema[id_].dataType.simpleString()
    if not points.limit(1).count():
        return rows.sparkSession.createDataFrame([], f"`{id_}` {kind}, cluster int, d2 double")
    starts = [start] if start is not None else [seeds(points, k, seed + r) for r in range(restarts)]
    c = min(lloyds(points, starts, rounds), key=lambda r: r[1])[0]

    def label(x):
        d = squares(x, c)
        return {"cluster": d.argmin(1).astype(np.int32), "d2": d.min(1)}

    return _labelled(points, kind, "cluster int, d2 double", label).withColumnRenamed("id", id_)


# ---------------------------------------------------------------- mixtures
def log_densities(x: np.ndarray, m: Mixture) -> np.ndarray:
    """log of weight times density of each row under each component."""
    d = x.shape[1]
    out = np.empty((len(x), len(m.weights)))
    for j in range(len(m.weights)):
        half = np.linalg.cholesky(m.covariances[j])
        z = np.linalg.solve(half, (x - m.means[j]).T)
        out[:, j] = np.log(m.weights[j]) - 0.5 * (d * np.log(2 * np.pi) + (z**2).sum(0)) - np.log(np.diag(half)).sum()
    return out


def responsibilities(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    log = log_densities(x, m)
    top = log.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log - top).sum(1))
    return np.exp(log - total[:, None]), total


def _products(x: np.ndarray, p: np.ndarray) -> dict[int, np.ndarray]:
    one = np.hstack([np.ones((len(x), 1)), x])
    return {j: (p[:, j, None] * one).T @ one for j in range(p.shape[1])}


def _estimated(sums: dict[int, np.ndarray], k: int, d: int, floor: float) -> Mixture:
    m = [sums[j].reshape(d + 1, d + 1) for j in range(k)]
    w = np.array([v[0, 0] for v in m]) + 1e-10
    mu = np.array([v[0, 1:] / n for v, n in zip(m, w, strict=True)])
    cov = np.array([v[1:, 1:] / n - np.outer(c, c) + floor * np.eye(d) for v, n, c in zip(m, w, mu, strict=True)])
    return Mixture(w / w.sum(), mu, cov)


def expectation_maximisation(points: DataFrame, centres: np.ndarray, rounds: int = 200, floor: float = 1e-6, tolerance: float = 1e-6) -> tuple[Mixture, float, int]:
    """The mixture, its log-likelihood and the number of rows, from the nearest of some centres on.

    Products are taken about the mean of the centres, so that large offsets cost no digits.
    """
    k, d = centres.shape
    shift = centres.mean(0)
    n = points.count()
    first = lambda x: _products(x - shift, np.eye(k)[squares(x, centres).argmin(1)])
    model, before, total = _estimated(_summed(points, first), k, d, floor), -np.inf, -np.inf
    for _ in range(rounds):

        def part(x, model=model):
            p, total = responsibilities(x - shift, model)
            return _products(x - shift, p) | {k: np.array([total.sum()])}

        sums = _summed(points, part)
        total = float(sums[k][0])
        if abs(total - before) < tolerance * max(1.0, abs(before)):
            break
        before, model = total, _estimated(sums, k, d, floor)
    return model._replace(means=model.means + shift), total, n


def mixture_clusters(rows: DataFrame, id_: str, vector: str, k: int, *, seed: int = 0, rounds: int = 200, floor: float = 1e-6) -> DataFrame:
    """id, cluster, its probability, and the model's bic and aic, of each row whose vector has numbers only, of one length."""
    points = _usable(rows, id_, vector)
    kind = rows.schema[id_].dataType.simpleString()
    columns = "cluster int, probability double, bic double, aic double"
    if not points.limit(1).count():
        return rows.sparkSession.createDataFrame([], f"`{id_}` {kind}, {columns}")
    model, total, n = expectation_maximisation(points, lloyd(points, seeds(points, k, seed))[0], rounds, floor)
    j, d = model.means.shape
    free = j * (d + d * (d + 1) / 2) + j - 1
    bic, aic = float(free * np.log(n) - 2 * total), float(2 * free - 2 * total)

    def label(x):
        p, _ = responsibilities(x, model)
        return {"cluster": p.argmax(1).astype(np.int32), "probability": p.max(1), "bic": np.full(len(x), bic), "aic": np.full(len(x), aic)}

    return _labelled(points, kind, columns, label).withColumnRenamed("id", id_)
