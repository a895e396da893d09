"""Embedding near-dedup: an exact metric range join over pivot cells.

Unit vectors have cosine >= c exactly when their distance is at most r = sqrt(2 - 2c). Every distinct vector goes to
the cell of its nearest pivot. By the triangle inequality it can have a partner in another cell only if it lies within
r of the plane between the two pivots and within r of the cell's radius; there it is replicated, to cells before its
own only, so each pair of cells is compared once. Cells join independently. A cell with many vectors is dealt over a
grid of blocks. A task sends a number of links and one link to its group's first member for each vector, never the
pairs.

Equal vectors collapse before the join and count in n_links. Vectors that are null, zero or hold null or non-finite
components link with nothing, nor do vectors of different dimension. Rows that repeat an id count one by one. Columns other
than vec_id and embedding are left away, whatever their names.

How far cells and bounds prune is up to the vectors: where all lie about as far from each other as from any pivot, as
random vectors of many dimensions do, nearly every vector is on a boundary and the join compares all pairs in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import Scratch, U, column, components, longs, mix, parts, small_batches

SAMPLE = 4096  # vectors that the pivots are fitted on
CAP = 4096  # vectors of a chunk; a block has two
SLACK = 1e-4  # of float32 products; what passes is computed again in double precision


def fitted(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means centres of a bounded sample, from a seed."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
    return np.unique(centres, axis=0)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def homes(pivots):
    """Of each distinct vector its cell and its distance to the cell's pivot."""

    def run(frames):
        for batch in frames:
            dims = longs(batch, "dim")
            cell, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d in pivots.value:
                    x = matrix(column(batch, "v").take(pa.array(rows)), int(d))
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    c = x @ pivots.value[d].T
                    cell[rows] = c.argmax(1)
                    far[rows] = np.sqrt(np.maximum(2 - 2 * c.max(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def shared(batch, rows, d, pivots, radii, r):
    """(i, cell): vectors rows[i] that may link into a cell other than their own, of a smaller number."""
    home, p = longs(batch, "cell")[rows], pivots.value[d]
    x = matrix(column(batch, "v").take(pa.array(rows)), int(d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dist = 2 - 2 * (x @ p.T)
    between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-18))[home]
    gap = (dist - dist[np.arange(len(rows)), home][:, None]) / (2 * between)
    edge = np.array([radii.value.get((d, c), -9.0) for c in range(len(p))])
    near = (gap <= r + 1e-7) & (np.sqrt(np.maximum(dist, 0)) <= edge + r + 1e-7) & (np.arange(len(p)) < home[:, None])
    return np.nonzero(near)


def guests(pivots, radii, r: float):
    """dim, cell and n: how many vectors of other cells each cell gets, summed by batch."""

    def run(frames):
        for batch in frames:
            dims = longs(batch, "dim")
            for d in (d for d in np.unique(dims) if d in pivots.value):
                n = np.bincount(shared(batch, np.flatnonzero(dims == d), d, pivots, radii, r)[1])
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"dim": np.full(len(cell), d), "cell": cell, "n": n[cell]})

    return run


def chunk_of(reps: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (mix(reps.view(U), 7) % np.maximum(n, 1).astype(U)).astype(np.int64)


def replicas(pivots, radii, sizes, more, r: float):
    """(dim, cell, row, col) of every block that a vector takes part in.

    A cell's own vectors stand in chunks of about CAP, 0 and on, and its guests in others, -1 and down. A block holds two
    chunks of its own, or one of each kind, so none holds more than two chunks however many vectors a cell has or gets.
    """

    def run(frames):
        for batch in frames:
            dims, cells, reps = (longs(batch, k) for k in ("dim", "cell", "rep"))
            out = []
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                home = cells[rows]
                count = lambda of: np.array([-(-of.value.get((d, c), 0) // CAP) for c in range(max(int(home.max()) + 1, len(pivots.value.get(d, ()))))])  # noqa: B023, E731
                grid, strange = np.maximum(count(sizes), 1), count(more)
                own = chunk_of(reps[rows], grid[home])
                for other in range(int(grid[home].max())):  # the chunks of its own cell
                    use = other < grid[home]
                    out.append((rows[use], home[use], np.minimum(own, other)[use], np.maximum(own, other)[use], own[use]))
                for other in range(int(strange[home].max())):  # and those of its guests
                    use = other < strange[home]
                    out.append((rows[use], home[use], own[use], np.full(use.sum(), -1 - other), own[use]))
                if d not in pivots.value:
                    continue
                i, c = shared(batch, rows, d, pivots, radii, r)
                own = -1 - chunk_of(reps[rows][i], strange[c])
                for block in range(int(grid[c].max()) if len(c) else 0):
                    use = block < grid[c]
                    out.append((rows[i[use]], c[use], np.full(use.sum(), block), own[use], own[use]))
            at, cell, row, col, own = (np.concatenate(x) for x in zip(*out, strict=True))
            for a in range(0, len(at), 1 << 15):
                z = slice(a, a + (1 << 15))
                some = batch.select(["rep", "mult", "dim", "v"]).take(pa.array(at[z]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell[z]), pa.array(row[z]), pa.array(col[z]), pa.array(own[z])], ["rep", "mult", "dim", "v", "cell", "row", "col", "own"])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links reach, for each of n."""
    top = np.arange(n)
    while len(a):
        low = np.minimum(top[a], top[b])
        before = top.copy()
        np.minimum.at(top, top[a], low)
        np.minimum.at(top, top[b], low)
        top = top[top]
        if (before == top).all():
            break
        keep = top[a] != top[b]
        if not keep.any():
            break
    while (top[top] != top).any():
        top = top[top]
    return top


def linked(cosine: float):
    """Of one block: rep, number of links (copies of partners counted) and a member that the rep is joined with."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, row, col = (group.column(k)[0].as_py() for k in ("dim", "row", "col"))
        rep, mult, own = (group.column(k).to_numpy() for k in ("rep", "mult", "own"))
        x = matrix(group.column("v").combine_chunks() if isinstance(group.column("v"), pa.ChunkedArray) else group.column("v"), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        first = np.flatnonzero(own == row)
        rest = first if row == col else np.flatnonzero(own == col)
        light, n = x.astype(np.float32), np.zeros(len(x), np.int64)
        lefts, rights = [], []
        top = np.arange(len(x))
        for a in range(0, len(first), 512):
            i = first[a : a + 512]
            for b in range(0, len(rest), 4096):
                j = rest[b : b + 4096]
                p, q = np.nonzero(light[i] @ light[j].T >= cosine - SLACK)
                p, q = i[p], j[q]
                keep = (p < q) | (own[q] != own[p])
                p, q = p[keep], q[keep]
                for c in range(0, len(p), 1 << 16):
                    s, t = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
                    good = np.einsum("ij,ij->i", x[s], x[t]) >= cosine
                    s, t = s[good], t[good]
                    np.add.at(n, s, mult[t])
                    np.add.at(n, t, mult[s])
                    apart = top[s] != top[t]
                    lefts.append(s[apart])
                    rights.append(t[apart])
                if sum(map(len, lefts)) > 1 << 18:
                    top = roots(len(x), np.concatenate([*lefts, np.arange(len(x))]), np.concatenate([*rights, top]))
                    lefts, rights = [], []
        top = roots(len(x), np.concatenate([*lefts, np.arange(len(x))]), np.concatenate([*rights, top]))
        hit = np.flatnonzero(n)
        return pa.table({"rep": rep[hit], "n": n[hit], "other": rep[top[hit]]})

    return run


def embedding_dedup(vectors: DataFrame, *, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    s, n = Scratch(spark), parts(spark)
    small_batches(spark)
    kind = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) or vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), False) else "double"
    v = F.col("embedding").cast(f"array<{kind}>")  # as they come: tasks compute in double precision
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).withColumn("ok", F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False)))
    good = rows.where("ok and vec_id is not null").select("vec_id", F.transform("v", lambda x: (x + F.lit(0).cast(kind))).alias("v"))
    reps = s.put(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("v").cast("long")), "distinct")

    total = reps.count()
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    k = max(8, round(total**0.5 / 8))
    fit = {d: fitted((m := np.array(x, float)) / np.linalg.norm(m, axis=1, keepdims=True), k) for d, x in by_dim.items() if len(x) > 1}
    pivots = spark.sparkContext.broadcast(fit)  # at most SAMPLE vectors
    housed = s.put(reps.mapInArrow(homes(pivots), f"v array<{kind}>, rep long, mult long, dim long, cell long, far double"), "homes")
    cells = housed.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count("*").alias("held")).collect()  # a row for each pivot
    radii = spark.sparkContext.broadcast({(r["dim"], r["cell"]): r["far"] for r in cells})
    sizes = spark.sparkContext.broadcast({(r["dim"], r["cell"]): r["held"] for r in cells})
    r = float(np.sqrt(2 - 2 * cosine))
    abroad = housed.mapInArrow(guests(pivots, radii, r), "dim long, cell long, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()  # a row for each pivot
    more = spark.sparkContext.broadcast({(g["dim"], g["cell"]): g["n"] for g in abroad})
    dealt = housed.mapInArrow(replicas(pivots, radii, sizes, more, r), f"rep long, mult long, dim long, v array<{kind}>, cell long, row long, col long, own long")
    found = s.put(dealt.repartition(max(n, len(cells)), "dim", "cell", "row", "col").groupBy("dim", "cell", "row", "col").applyInArrow(linked(cosine), "rep long, n long, other long"), "found")
    comp = components(s, found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")), "comp")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = s.put(reps.join(links, "rep", "left").join(comp, reps.rep == comp.v, "left").select(reps.v, "mult", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("comp", "rep").alias("comp")), "known")
    done = good.join(known, "v").select("vec_id", (F.col("n") + F.col("mult") - 1).alias("n_links"), F.col("comp").alias("component_id"))
    s.drop("distinct", "homes", "found", *(f"comp_{t}" for t in ("links", "0", "1", "2", "spread")))
    alone = rows.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
