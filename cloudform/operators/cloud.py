"""The shape of clouds of vectors: dispersion, neighbours, hubs, graph, spectrum, drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..functions.vec import EPS, centroids, cosine_distance, listed, matrices, norm, unit
from ..sources.scratch import settle
from .quantiles import MOST, group_percentiles

CAP = 8192  # vectors of a chunk; a group of more is dealt over a grid of blocks of two chunks
PIECE = 2048  # vectors of a chunk that are compared with 512 others at once


def _with_units(frames):
    for batch in frames:
        name = batch.schema.names[-1]
        a = batch.column(name)
        at, made = [np.zeros(0, np.int64)], []
        for rows, x in matrices(a):
            n = np.sqrt(np.einsum("ij,ij->i", x, x))
            good = np.isfinite(n) & (n > EPS)
            at.append(rows[good])
            made.append(x[good] / n[good, None])
        rest = batch.select(batch.schema.names[:-1])
        for rows, u in zip(at[1:], made, strict=True):  # one for each dimension
            yield pa.RecordBatch.from_arrays([*rest.take(pa.array(rows)).columns, listed(np.arange(len(rows)), u, len(rows))], [*rest.schema.names, "u"])


def unit_rows(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a unit vector u in place of the vector; zero, null and non-finite vectors go."""
    rest = [f for f in vectors.schema.fields if f.name not in (vector, "u")]
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["u array<double>"])
    return vectors.select(*(f.name for f in rest), F.col(vector).cast("array<double>").alias("u")).mapInArrow(_with_units, kind)


def fit(sizes: DataFrame) -> bool:
    """Whether all groups of sizes(n, ...) are small enough for one task to hold their values."""
    return not sizes.where(F.col("n") > MOST).limit(1).count()


def dispersion(rows: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Per group: size, norm of the mean unit vector, and the cosine distances to it. sizes(keys, n) bounds the groups' sizes."""
    c = centroids(rows, keys, "u")
    d = rows.select(*keys, "u").join(c.withColumn("norm", norm("centroid")), keys).select(*keys, "norm", cosine_distance("u", "centroid").alias("d"))
    shares = [0.25, 0.5, 0.75, 0.9]
    means = [F.count("*").alias("n"), F.first("norm").alias("centroid_norm"), F.avg("d").alias("mean_distance"), F.stddev_pop("d").alias("std_distance")]
    if sizes is not None and fit(sizes):
        out = d.groupBy(*keys).agg(*means, F.percentile("d", F.array(*map(F.lit, shares))).alias("q"))
    else:
        d = settle(d)
        out = d.groupBy(*keys).agg(*means).join(group_percentiles(d, keys, "d", shares), keys)
    return out.select(*keys, "n", "centroid_norm", "mean_distance", "std_distance", F.col("q")[1].alias("median_distance"), (F.col("q")[2] - F.col("q")[0]).alias("iqr_distance"), F.col("q")[3].alias("p90_distance"), ratio(F.col("q")[3], F.col("q")[1]).alias("p90_to_median"))


def column_matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    (_, x), *_ = matrices(table.column(name).combine_chunks())
    return x


def _best(x: np.ndarray, y: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, k: int, same: bool):
    """(row of x, row of y, distance) of the k nearest of each row, ties by id. same: x and y are one chunk.

    Pieces of y come one by one. Only the first is searched for its k nearest; of the others only what is not farther than
    the k-th so far is looked at, with room for the rounding.
    """
    for a in range(0, len(x), 512):
        rows = x[a : a + 512]
        cut, r, c, d = np.full(len(rows), np.inf), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(y), PIECE):
            m = 1 - rows @ y[b : b + PIECE].T
            if same:
                m[ids_x[a : a + 512][:, None] == ids_y[b : b + PIECE][None, :]] = np.inf
            if b == 0:
                cut = np.partition(m, min(k, m.shape[1]) - 1, axis=1)[:, min(k, m.shape[1]) - 1]
                cut = np.maximum(cut, 0) + 2e-12
            i, j = np.nonzero((m <= cut[:, None]) & (m < np.inf))
            r, c, d = np.append(r, i), np.append(c, j + b), np.append(d, np.clip(m[i, j], 0, 2))
            near = np.round(d, 12)
            by = np.lexsort((ids_y[c], near, r))
            first = np.searchsorted(r[by], np.arange(len(rows)))
            by = by[np.arange(len(by)) - first[r[by]] < k]
            r, c, d = r[by], c[by], d[by]
            last = np.searchsorted(r, np.arange(len(rows)), "right")
            full = np.bincount(r, minlength=len(rows)) >= k
            cut = np.full(len(rows), np.inf)
            cut[full] = d[last[full] - 1] + 2e-12
        yield r + a, c, d


def _nearest(k: int):
    def run(group: pa.Table) -> pa.Table:
        ids, u, chunk = group.column("id").to_numpy(), column_matrix(group, "u"), group.column("chunk").to_numpy()
        row, col = (group.column(c)[0].as_py() for c in ("row", "col"))
        out = []
        for one, two in {(row, col), (col, row)}:
            q, c = np.flatnonzero(chunk == one), np.flatnonzero(chunk == two)
            if len(q) and len(c):
                out += [(ids[q[i]], ids[c[j]], d) for i, j, d in _best(u[q], u[c], ids[q], ids[c], k, one == two)]
        src, dst, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"g": pa.array([group.column("g")[0].as_py()] * len(src), pa.string()), "src": src, "dst": dst, "d": d})

    return run


def neighbours(rows: DataFrame, group: str, id_: str, k: int, counts: DataFrame | None = None) -> DataFrame:
    """(group, src, dst, d, rank): the k nearest others by cosine in the same group, ties by id. Exact.

    A group of n vectors is dealt over a grid of blocks of two chunks of CAP vectors, both ways at once: each vector is
    copied n / CAP times, and the exact form compares all pairs of a group. Blocks keep their k best; a merge keeps the
    k best of all. counts(group, n), where a table of sizes or of bounds of them is there already, saves a pass.
    """
    n = rows.groupBy(group).agg(F.count("*").alias("n")) if counts is None else counts
    sizes = n.select(group, F.ceil(F.col("n") / CAP).cast("int").alias("side"))
    own = rows.select(F.col(group).cast("string").alias("g"), F.col(group).alias("key"), F.col(id_).alias("id"), "u").join(sizes.select(F.col(group).alias("key"), "side"), "key")
    own = own.withColumn("chunk", F.pmod(F.xxhash64("id"), "side").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    dealt = own.select("g", "id", "u", "chunk", F.least("chunk", "other").alias("row"), F.greatest("chunk", "other").alias("col"))
    found = dealt.groupBy("g", "row", "col").applyInArrow(_nearest(k), "g string, src long, dst long, d double")
    w = Window.partitionBy("g", "src").orderBy(F.round("d", 12), "dst")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("g").cast(rows.schema[group].dataType).alias(group), "src", "dst", "d", "rank")


def neighbour_stats(near: DataFrame, group: str, sizes: DataFrame | None = None) -> DataFrame:
    """Means and percentiles of the neighbours' distances. sizes(group, n) bounds the groups' numbers of pairs."""
    shares = [0.5, 0.9]
    means = [F.count("*").alias("n_pairs"), F.avg("d").alias("mean_knn"), F.stddev_pop("d").alias("s")]
    if sizes is not None and fit(sizes):
        out = near.groupBy(group).agg(*means, F.percentile("d", F.array(*map(F.lit, shares))).alias("q"))
    else:
        near = settle(near.select(group, "d"))
        out = near.groupBy(group).agg(*means).join(group_percentiles(near, [group], "d", shares), group)
    return out.select(group, "n_pairs", "mean_knn", F.col("q")[0].alias("median_knn"), F.col("q")[1].alias("p90_knn"), ratio(F.col("s"), F.col("mean_knn")).alias("cv_knn"))


def gini(values: DataFrame, group: str, value: str) -> DataFrame:
    """Gini coefficient by group, 0 where all is 0, from sums over equal values rather than sorted rows."""
    counts = values.groupBy(group, value).agg(F.count("*").alias("c"))
    below = F.sum("c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    c, rank = F.col("c"), F.coalesce("below", F.lit(0)) + (F.col("c") + 1) / 2
    w = counts.withColumn("below", below).groupBy(group).agg(F.sum(rank * c * F.col(value)).alias("w"), F.sum(c * F.col(value)).alias("s"), F.sum("c").alias("n"))
    return w.select(group, F.when(F.col("s") > EPS, 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def hub_gini(rows: DataFrame, near: DataFrame, group: str, id_: str) -> DataFrame:
    """Inequality of how often each vector is a neighbour, vectors that never are included."""
    got = near.groupBy(group, "dst").count()
    all_ = rows.select(group, F.col(id_).alias("dst")).join(got, [group, "dst"], "left").select(group, F.coalesce("count", F.lit(0)).cast("double").alias("degree"))
    return gini(all_, group, "degree").withColumnRenamed("gini", "hub_gini")


def graph_edges(near: DataFrame, group: str) -> DataFrame:
    """The neighbour graph as undirected edges of positive length."""
    return near.where(F.col("d") > EPS).groupBy(group, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("d").alias("d"))


def graph_components(rows: DataFrame, edges: DataFrame, group: str, id_: str) -> DataFrame:
    """Per group: number of components of the graph and the share of the largest. Minimum labels spread and jump."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct()
    both = settle(both)
    labels = settle(rows.select(group, F.col(id_).alias("v"), F.col(id_).alias("comp")))
    before = None
    while True:
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
        sent = both.join(labels.select("v", "comp"), "v").groupBy(F.col("w").alias("v")).agg(F.min("comp").alias("near"))
        spread = labels.join(sent, "v", "left").select(group, "v", F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = spread.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        labels = settle(spread.join(up, "comp").select(group, "v", F.col("root").alias("comp")))
    sizes = labels.groupBy(group, "comp").count()
    return sizes.groupBy(group).agg(F.count("*").alias("n_components"), (F.max("count") / F.sum("count")).alias("largest_share"))


HELD = 1 << 26  # bytes of matrices that a task holds at once
TILE = 1 << 16  # components of a tile
HAND = 16  # groups whose matrices a task may meet without rows being dealt by group
CHUNK = 1 << 16  # rows of a group that go to one task then


def _moments(frames):
    """g, width, tile and m: by group, rows of the matrix of sums of products of (1, vector), some rows to a tile.

    Its first row holds the number of vectors and their sum. What is held is sent whenever it reaches HELD bytes.
    """
    sums: dict = {}

    def tiles():
        for (key, w), m in sums.items():
            step = max(1, TILE // w)
            for t in range(0, w, step):
                yield pa.RecordBatch.from_pydict({"g": pa.array([key], pa.string()), "width": pa.array([w], pa.int32()), "tile": pa.array([t // step], pa.int32()), "m": [m[t : t + step].ravel()]})
        sums.clear()

    for batch in frames:
        keys = batch.column(0).dictionary_encode()
        at = np.asarray(keys.indices.fill_null(-1))
        for rows, x in matrices(batch.column(1)):
            one = np.hstack([np.ones((len(x), 1)), x])
            for i in np.unique(at[rows]):
                some = one[at[rows] == i]
                key = (keys.dictionary[i].as_py() if i >= 0 else None, one.shape[1])
                if key not in sums and sum(m.nbytes for m in sums.values()) + 8 * key[1] ** 2 > HELD:
                    yield from tiles()
                sums[key] = sums.get(key, 0) + some.T @ some
    yield from tiles()


def moments(rows: DataFrame, group: F.Column, vector: str, *, deal: bool = False) -> DataFrame:
    """g, width, tile and m, summed over all rows; see _moments.

    deal: rows of one group are brought together, CHUNK at a time, so that a task meets few groups. Tiles are summed by
    Spark's summarizer, which keeps one tile for each key however many tasks send some.
    """
    some = rows.select(group.cast("string").alias("g"), F.col(vector).alias("x"))
    if deal:
        n = some.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / CHUNK).alias("salts"))
        some = some.join(F.broadcast(n) if n.limit(CHUNK).count() < CHUNK else n, F.col("g").eqNullSafe(F.col("_g")))
        some = some.select("g", "x", F.pmod(F.xxhash64("x"), "salts").alias("salt"))
        some = some.repartition("g", "salt").sortWithinPartitions("g").select("g", "x")
    parts = some.mapInArrow(_moments, "g string, width int, tile int, m array<double>")
    return parts.groupBy("g", "width", "tile").agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))


def whole_matrix(tiles: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and matrix of sums of products of one group, from its tiles; of several lengths of vectors the most frequent."""
    best = (0, np.zeros(0), np.zeros((0, 0)))
    for w in sorted(set(tiles.column("width").to_pylist())):
        own = tiles.filter(pc.equal(tiles.column("width"), w)).sort_by("tile")
        m = own.column("m").combine_chunks().flatten().to_numpy().reshape(w, w)
        if round(m[0, 0]) > best[0]:
            best = round(m[0, 0]), m[0, 1:], m[1:, 1:]
    return best


def _spectrum(tiles: pa.Table) -> pa.Table:
    n, s, ss = whole_matrix(tiles)
    d = len(s)
    out = {"g": pa.array([tiles.column("g")[0].as_py()], pa.string()), "n": [n]}
    cov = ss - np.outer(s, s) / n
    values = np.maximum(np.linalg.eigvalsh(cov)[::-1][: max(min(n - 1, d), 0)], 0)
    if n < 2 or values.sum() <= EPS:
        return pa.table(out | {k: pa.array([None], pa.float64()) for k in ("top1", "top3", "top5", "d50", "d80", "participation", "entropy")})
    r = values / values.sum()
    run, p = np.cumsum(r), r[r > EPS]
    row = [r[:1].sum(), r[:3].sum(), r[:5].sum(), float((run >= 0.5 - EPS).argmax() + 1), float((run >= 0.8 - EPS).argmax() + 1), 1 / (r**2).sum(), float(-(p * np.log(p)).sum() / np.log(len(r))) if len(r) > 1 else None]
    return pa.table(out | {k: pa.array([v], pa.float64()) for k, v in zip(("top1", "top3", "top5", "d50", "d80", "participation", "entropy"), row, strict=True)})


def spectrum(rows: DataFrame, group: str, sizes: DataFrame | None = None) -> DataFrame:
    """Variance shares, dimensions, participation ratio and entropy of each group's principal components.

    Sums of products are formed by task, so a group never has to fit in one, and a task holds a bounded number of matrices
    however many groups there are. sizes(group, ...), a row for each group, tells whether there are many.
    """
    some = sizes if sizes is not None else rows.select(group).distinct()
    part = moments(rows, F.col(group), "u", deal=some.limit(HAND + 1).count() > HAND)
    out = part.groupBy("g").applyInArrow(_spectrum, "g string, n long, top1 double, top3 double, top5 double, d50 double, d80 double, participation double, entropy double")
    return out.select(F.col("g").cast(rows.schema[group].dataType).alias(group), *out.columns[1:])


def drift(rows: DataFrame, group: str, first: int, last: int, edge: int = 5, least: int = 3) -> DataFrame:
    """Cosine distance between the centroids of the first and the last years, if both have enough rows.

    Both edges have `edge` years, or all years of a shorter range; so they overlap in ranges under two edges.
    """
    early, late = F.col("year") <= min(first + edge - 1, last), F.col("year") >= max(last - edge + 1, first)
    sides = F.filter(F.array(F.when(early, "early"), F.when(late, "late")), lambda x: x.isNotNull())
    some = rows.where(F.col("year").between(first, last)).select(group, "u", F.explode(sides).alias("side"))
    n = some.groupBy(group, "side").count()
    c = centroids(some, [group, "side"], "u").join(n, [group, "side"])
    at = lambda name, column: F.max(F.when(F.col("side") == name, F.col(column)))
    sides = c.groupBy(group).agg(at("early", "centroid").alias("early"), at("late", "centroid").alias("late"), at("early", "count").alias("n_early"), at("late", "count").alias("n_late"))
    out = rows.select(group).distinct().join(sides, group, "left").na.fill(0, ["n_early", "n_late"])
    enough = (F.col("n_early") >= least) & (F.col("n_late") >= least)
    return out.select(group, F.when(enough, cosine_distance("early", "late")).alias("drift"), "n_early", "n_late")


def annual_path(rows: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Sum of the cosine distances between the centroids of consecutive years that have enough rows."""
    n = rows.groupBy(group, "year").count().where(F.col("count") >= least)
    c = centroids(rows.join(n, [group, "year"], "left_semi"), [group, "year"], "u")
    step = c.withColumn("before", F.lag("centroid").over(Window.partitionBy(group).orderBy("year")))
    return step.groupBy(group).agg(F.count("*").alias("n_years"), F.sum(cosine_distance("centroid", "before")).alias("path"))


def unit_centroids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return centroids(rows, keys, "u").withColumn("centroid", unit("centroid"))
