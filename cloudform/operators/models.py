"""Grids of clusterings, their stability, mixtures, spectral clustering, principal scores and classical scaling.

The tables clustered here have a row for each entity, so one model fits in one task; a grid is dealt over tasks by model.
Scores of principal components are for any number of rows: moments are summed by task and rows are projected natively.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import listed, matrices
from .cloud import column_matrix, moments, whole_matrix
from .cluster import adjusted_mutual_information, kmeans, linked

HELD = 1 << 20  # differences of components that are held at once


def gaps(x: np.ndarray, metric: str = "euclid") -> np.ndarray:
    """Distances of all pairs of rows: euclid, cosine or correlation; rows without spread are at distance 1 of the others."""
    if metric == "euclid":
        out = np.empty((len(x), len(x)))
        step = max(1, HELD // max(x.size, 1))
        for a in range(0, len(x), step):  # differences of all pairs at once would take len(x) times the matrix of vectors
            part = x[a : a + step, None] - x[None]
            out[a : a + step] = (part * part).sum(-1)
        return np.sqrt(out, out=out)
    y = x - x.mean(1, keepdims=True) if metric == "correlation" else x
    n = np.linalg.norm(y, axis=1, keepdims=True)
    y = np.where(n > 1e-12, y / np.maximum(n, 1e-12), 0)
    d = np.clip(1 - y @ y.T, 0, 2)
    np.fill_diagonal(d, 0)
    return d


def embedded(a: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means of the rows of the leading eigenvectors of a normalised affinity."""
    root = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    v = np.linalg.eigh(a * root[:, None] * root[None])[1][:, -k:]
    return kmeans(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), k, seed)


def spectral(d: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Labels from the affinity exp(-d² / 2 median²)."""
    off = d[~np.eye(len(d), dtype=bool)]
    scale = np.median(off) if len(off) else 1.0
    a = np.exp(-(d**2) / (2 * max(scale, 1e-12) ** 2))
    np.fill_diagonal(a, 0)
    return embedded(a, k, seed)


def nearest_affinity(d: np.ndarray, n: int) -> np.ndarray:
    """The graph of the n nearest (each row itself among them), averaged with its reverse."""
    by = np.argsort(d, axis=1, kind="stable")[:, : min(n, len(d))]
    a = np.zeros_like(d)
    np.put_along_axis(a, by, 1.0, 1)
    return (a + a.T) / 2


def mixture(x: np.ndarray, k: int, seed: int = 0, rounds: int = 200, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float, float]:
    """A Gaussian mixture with full covariances from a k-means start: labels, their probabilities, BIC and AIC."""
    n, d = x.shape
    p = np.eye(k)[kmeans(x, k, seed, 10)]
    before = -np.inf
    for _ in range(rounds):
        w = p.sum(0) + 1e-10
        mu = p.T @ x / w[:, None]
        log = np.empty((n, k))
        for j in range(k):
            c = x - mu[j]
            cov = (p[:, j, None] * c).T @ c / w[j] + floor * np.eye(d)
            half = np.linalg.cholesky(cov)
            z = np.linalg.solve(half, c.T)
            log[:, j] = np.log(w[j] / n) - 0.5 * (d * np.log(2 * np.pi) + (z**2).sum(0)) - np.log(np.diag(half)).sum()
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        p = np.exp(log - total[:, None])
        if abs(total.sum() - before) < 1e-6 * max(1.0, abs(before)):
            break
        before = total.sum()
    free = k * (d + d * (d + 1) / 2) + k - 1
    return p.argmax(1), p.max(1), float(free * np.log(n) - 2 * total.sum()), float(2 * free - 2 * total.sum())


def labelled(x: np.ndarray, k: int, method: str, seed: int = 0) -> np.ndarray:
    """Labels by `ward`, `average`, `complete`, `kmeans`, `mixture` or `spectral`; `average:cosine` and the like name a distance."""
    name, _, metric = method.partition(":")
    k = min(k, len(x))
    if name == "kmeans":
        return kmeans(x, k, seed)
    if name == "mixture":
        return mixture(x, k, seed)[0]
    if name == "spectral" and metric.startswith("knn"):
        return embedded(nearest_affinity(gaps(x), int(metric[3:] or 10)), k, seed)
    d = gaps(x, metric or "euclid")
    return spectral(d, k, seed) if name == "spectral" else linked(d, k, name)


def mean_silhouette(d: np.ndarray, y: np.ndarray) -> float | None:
    """NULL for one cluster or as many as rows; 0 for members of clusters of one."""
    names, at = np.unique(y, return_inverse=True)
    if not 1 < len(names) < len(y):
        return None
    sums = d @ np.eye(len(names))[at]
    size = np.bincount(at)
    own = sums[np.arange(len(y)), at] / np.maximum(size[at] - 1, 1)
    sums = sums / size
    sums[np.arange(len(y)), at] = np.inf
    other = sums.min(1)
    top = np.maximum(own, other)
    return float(np.where((size[at] > 1) & (top > 1e-12), (other - own) / np.maximum(top, 1e-12), 0).mean())


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """The adjusted Rand index; 1 where both labellings are trivial alike."""
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    two = lambda v: (v * (v - 1) / 2).sum()
    both, left, right, n = two(t), two(t.sum(1)), two(t.sum(0)), len(a)
    want = left * right / max(n * (n - 1) / 2, 1)
    top = (left + right) / 2 - want
    return 1.0 if abs(top) < 1e-12 else float((both - want) / top)


def _sorted(group: pa.Table, id_: str, vector: str) -> np.ndarray:
    return np.array(group.sort_by([(id_, "ascending")]).column(vector).to_pylist(), float)


def model_grid(points: DataFrame, id_: str, vector: str, methods: list[str], ks: list[int], seed: int = 0) -> DataFrame:
    """One row for each method and number of clusters: sizes and silhouette. Models with more clusters than rows have no score."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        method, k = (v.as_py() for v in key)
        x = _sorted(group, id_, vector)
        y = labelled(x, k, method, seed)
        size = np.sort(np.bincount(np.unique(y, return_inverse=True)[1]))[::-1]
        score = mean_silhouette(gaps(x, method.partition(":")[2] or "euclid"), y)
        return pa.table({"method": [method], "k": pa.array([k], pa.int32()), "n": [len(x)], "min_size": [int(size[-1])], "max_size": [int(size[0])], "silhouette": pa.array([score], pa.float64()), "sizes": [";".join(map(str, size))]})

    models = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(k).alias("k")) for m in methods for k in ks)))
    some = points.where(F.col(vector).isNotNull()).select(id_, vector, models.alias("m")).select(id_, vector, "m.method", "m.k")
    return some.groupBy("method", "k").applyInArrow(run, "method string, k int, n long, min_size long, max_size long, silhouette double, sizes string")


def variant_grid(variants: dict[str, DataFrame], id_: str, vector: str, methods: list[str], ks: list[int], seed: int = 0) -> DataFrame:
    """The grid of models over several representations of the same entities, by name."""
    out = None
    for name, points in variants.items():
        one = model_grid(points, id_, vector, methods, ks, seed).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def distance_grid(pairs: DataFrame, value: str, methods: list[str], ks: list[int], seed: int = 0) -> DataFrame:
    """The grid of models on the distances of pairs(a, b, value) of few entities; missing pairs are at the mean distance."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        method, k = (v.as_py() for v in key)
        d = matrix_of(*(group.column(c).to_pylist() for c in ("a", "b", value)))[1]
        k = min(k, len(d))
        y = spectral(d, k, seed) if method == "spectral" else linked(d, k, method)
        size = np.sort(np.bincount(np.unique(y, return_inverse=True)[1]))[::-1]
        return pa.table({"method": [method], "k": pa.array([key[1].as_py()], pa.int32()), "n": [len(d)], "min_size": [int(size[-1])], "max_size": [int(size[0])], "silhouette": pa.array([mean_silhouette(d, y)], pa.float64())})

    models = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(k).alias("k")) for m in methods for k in ks)))
    some = pairs.select("a", "b", F.col(value).cast("double").alias(value), models.alias("m")).select("a", "b", value, "m.method", "m.k")
    return some.groupBy("method", "k").applyInArrow(run, "method string, k int, n long, min_size long, max_size long, silhouette double")


def matrix_of(a: list, b: list, d: list) -> tuple[list, np.ndarray]:
    """Names in order and the symmetric matrix of pairs; missing pairs are at the mean distance."""
    names = sorted({*a, *b})
    at = {v: i for i, v in enumerate(names)}
    m = np.full((len(names),) * 2, np.mean([x for x in d if x is not None] or [0.0]))
    for x, y, z in zip(a, b, d, strict=True):
        if z is not None:
            m[at[x], at[y]] = m[at[y], at[x]] = z
    np.fill_diagonal(m, 0)
    return names, m


def stability(points: DataFrame, id_: str, vector: str, method: str, k: int, runs: int = 100, part: float = 0.8, seed: int = 0) -> DataFrame:
    """For each run: ARI and AMI of a clustering of a part of the rows, without replacement, with that of all rows."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i = key[0].as_py()
        x = _sorted(group, id_, vector)
        some = np.sort(np.random.default_rng((seed, i)).permutation(len(x))[: max(1, round(part * len(x)))])
        a, b = labelled(x, k, method, seed)[some], labelled(x[some], k, method, seed)
        ami = adjusted_mutual_information(np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1])
        return pa.table({"run": pa.array([i], pa.int32()), "n": [len(some)], "ari": [rand_index(a, b)], "ami": [float(ami)]})

    dealt = points.where(F.col(vector).isNotNull()).select(id_, vector, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return dealt.groupBy("run").applyInArrow(run, "run int, n long, ari double, ami double")


def mixture_members(points: DataFrame, id_: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """Cluster and probability of each row under a Gaussian mixture, with the model's BIC and AIC."""
    kind = points.schema[id_].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(id_, "ascending")])
        y, p, bic, aic = mixture(np.array(group.column(vector).to_pylist(), float), min(k, len(group)), seed)
        return pa.table({id_: group.column(id_), "cluster": pa.array(y.astype(np.int32)), "probability": p, "bic": np.full(len(y), bic), "aic": np.full(len(y), aic)})

    one = points.where(F.col(vector).isNotNull()).select(id_, vector, F.lit(0).alias("one"))
    return one.groupBy("one").applyInArrow(run, f"{id_} {kind}, cluster int, probability double, bic double, aic double")


def principal_axes(points: DataFrame, vector: str, n: int | None = 2, share: float = 1.0) -> DataFrame:
    """Centre, axes and shares of variance of the first n components, or of as many as reach a share of the variance.

    One row. The largest entry of an axis is positive, which fixes its sign.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, s, ss = whole_matrix(group)
        value, axes = np.linalg.eigh(ss / rows - np.outer(s, s) / rows**2)
        value, axes = np.maximum(value[::-1], 0), axes[:, ::-1].T
        part = value / max(value.sum(), 1e-300)
        m = min(n or len(s), int((np.cumsum(part) < share - 1e-9).sum()) + 1 if share < 1 else len(s))
        axes = axes[:m] * np.sign(axes[np.arange(m), np.abs(axes[:m]).argmax(1)])[:, None]
        return pa.table({"centre": [(s / rows).tolist()], "axes": [axes.tolist()], "shares": [part[:m].tolist()]})

    part = moments(points.where(F.col(vector).isNotNull()), F.lit("all"), vector)
    return part.groupBy("g").applyInArrow(run, "centre array<double>, axes array<array<double>>, shares array<double>")


def principal_scores(points: DataFrame, id_: str, vector: str, n: int | None = 2, share: float = 1.0) -> DataFrame:
    """Scores of each row on the principal axes, and their shares of variance. The axes, one row, go to every task."""
    rows = points.where(F.col(vector).isNotNull()).select(id_, F.col(vector).alias("x"))
    kind = f"`{id_}` {points.schema[id_].dataType.simpleString()}, scores array<double>, shares array<double>"
    one = principal_axes(points, vector, n, share).first()
    if one is None:
        return points.sparkSession.createDataFrame([], kind)
    centre, axes, shares = np.array(one.centre), np.array(one.axes), np.array(one.shares)

    def run(frames):
        for batch in frames:
            for at, x in matrices(batch.column(1)):
                every = np.arange(len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), listed(every, (x - centre) @ axes.T, len(at)), listed(every, np.tile(shares, (len(at), 1)), len(at))], [id_, "scores", "shares"])

    return rows.mapInArrow(run, kind)


def joined_blocks(blocks: list[DataFrame], id_: str, vector: str) -> DataFrame:
    """One vector for each id that all blocks have, each block divided by the root of its length so that blocks weigh alike."""
    part = [b.select(id_, F.transform(vector, lambda v: v / F.sqrt(F.size(vector))).alias(f"_b{i}")) for i, b in enumerate(blocks)]
    out = part[0]
    for p in part[1:]:
        out = out.join(p, id_)
    return out.select(id_, F.concat(*(f"_b{i}" for i in range(len(part)))).alias(vector))


def classical_scaling(pairs: DataFrame, level: str, value: str, n: int = 2) -> DataFrame:
    """Points in n dimensions whose distances come near those of pairs(level, a, b, value); missing pairs are at the mean distance."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        names, m = matrix_of(*(group.column(c).to_pylist() for c in ("a", "b", value)))
        c = np.eye(len(m)) - 1 / len(m)
        w, v = np.linalg.eigh(-0.5 * c @ m**2 @ c)
        w, v = w[::-1][:n], v[:, ::-1][:, :n]
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) * np.sqrt(np.maximum(w, 0))
        return pa.table({level: [key[0].as_py()] * len(names), "entity": names, "point": v.tolist()})

    return pairs.select(level, "a", "b", value).groupBy(level).applyInArrow(run, f"{level} string, entity string, point array<double>")


def verdict(ari) -> Column:
    """How far two partitions agree, by their adjusted Rand index."""
    v = F.col(ari) if isinstance(ari, str) else ari
    return F.when(v.isNull(), "unknown").when(v >= 0.5, "agree").when(v >= 0.2, "partly").otherwise("differ")
