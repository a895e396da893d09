"""Shape of densities on a grid and of points in the plane: peaks, components, holes, outline, spanning trees.

A group's grid has at most size² cells, so each group is one bounded task; points are summed to cells before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle, written
from . import density, features, summaries
from .entities import numbered

NEAR8 = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
NEAR4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def regions(mask: np.ndarray, near: list[tuple[int, int]]) -> np.ndarray:
    """Labels 1, 2, ... of the connected regions of a mask, 0 outside; the smallest label spreads until nothing changes."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    wide = np.pad(lab, 1)
    n, m = mask.shape
    while True:
        best = np.where(mask, lab, 0)
        for i, j in near:
            o = wide[1 + i : 1 + i + n, 1 + j : 1 + j + m]
            best = np.where(mask & (o > 0) & (o < best), o, best)
        if (best == lab).all():
            return np.unique(lab, return_inverse=True)[1].reshape(mask.shape) + (0 if (lab == 0).any() else 1)
        lab = best
        wide = np.pad(lab, 1)


def mass_mask(m: np.ndarray, share: float) -> np.ndarray:
    """The fewest cells that hold a share of the mass, ties by place."""
    order = np.argsort(-m.ravel(), kind="stable")
    run = np.cumsum(m.ravel()[order])
    out = np.zeros(m.size, bool)
    out[order[: int((run < share * m.sum() - 1e-12).sum()) + 1]] = True
    return out.reshape(m.shape) & (m > 0)


def peaks(m: np.ndarray, least: float) -> np.ndarray:
    """Cells that no neighbour exceeds, of equal neighbours the first, with at least a share of the highest mass."""
    wide = np.pad(m, 1, constant_values=-1.0)
    n, k = m.shape
    top = (m > 0) & (m >= least * m.max())
    for i, j in NEAR8:
        o = wide[1 + i : 1 + i + n, 1 + j : 1 + j + k]
        top &= (m > o) if (i, j) < (0, 0) else (m >= o)
    return np.argwhere(top)


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull, 0 for fewer than three corners."""
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    corners: list = []
    for side in (pts, pts[::-1]):
        start = len(corners)
        for p in side:
            while len(corners) - start >= 2 and turn(corners[-2], corners[-1], p) <= 0:
                corners.pop()
            corners.append(p)
        corners.pop()
    x, y = np.array(corners or [(0, 0)], float).T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def outline(mask: np.ndarray) -> int:
    """Sides of cells between the mask and what is outside."""
    wide = np.pad(mask, 1).astype(int)
    return int(np.abs(np.diff(wide, axis=0)).sum() + np.abs(np.diff(wide, axis=1)).sum())


def entropy(p: np.ndarray) -> float | None:
    """Of shares, over the logarithm of their number; NULL for fewer than two."""
    p = p[p > 1e-12] / p.sum()
    return float(-(p * np.log(p)).sum() / np.log(len(p))) if len(p) > 1 else None


def measured(m: np.ndarray, core: float, support: float, least: float) -> dict[str, float | None]:
    inner, outer, top = mass_mask(m, core), mass_mask(m, support), peaks(m, least)
    cells = np.argwhere(inner)
    mine = ((cells[:, None] - top[None]) ** 2).sum(-1).argmin(1)
    held = np.bincount(mine, m[inner], len(top))
    lab = regions(inner, NEAR8)
    names = np.unique(lab[lab > 0])
    mass = np.array([m[lab == v].sum() for v in names])
    mid = np.array([(np.argwhere(lab == v) * m[lab == v][:, None]).sum(0) / m[lab == v].sum() for v in names])
    apart = np.sqrt(((mid[:, None] - mid[None]) ** 2).sum(-1))
    weight = np.outer(mass, mass) * ~np.eye(len(mass), dtype=bool)
    back = regions(np.pad(~outer, 1, constant_values=True), NEAR4)
    side, area = outline(outer), int(outer.sum())
    at = np.argwhere(outer)
    hull = hull_area(np.concatenate([at + d for d in ([0, 0], [0, 1], [1, 0], [1, 1])]))
    return {
        "n_peaks": float(len(top)), "peak_entropy": entropy(held), "n_components": float(len(names)), "largest_component": float(mass.max() / mass.sum()),
        "separation": float((apart * weight).sum() / weight.sum() / np.hypot(*m.shape)) if len(names) > 1 else None,
        "n_holes": float(len(np.unique(back[back > 0])) - 1), "area": float(area), "perimeter": float(side), "solidity": area / hull, "circularity": 4 * np.pi * area / side**2,
    }


COLUMNS = ("n_peaks", "peak_entropy", "n_components", "largest_component", "separation", "n_holes", "area", "perimeter", "solidity", "circularity")


def density_shape(grid: DataFrame, group: str, size: int, core: float = 0.5, support: float = 0.9, least: float = 0.2) -> DataFrame:
    """Peaks, components and outline of each group's grid(group, ix, iy, mass); lengths and areas are in cells.

    Holes are regions outside the support that do not reach the border. Cells of NULL or no mass are empty, and a
    group without mass gives no row.
    """
    kind = grid.schema[group].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        m = np.zeros((size, size))
        np.add.at(m, (t.column("ix").to_numpy(), t.column("iy").to_numpy()), t.column("mass").to_numpy())
        row = measured(m, core, support, least)
        return pa.table({group: pa.array([key[0].as_py()], t.schema.field(group).type)} | {c: pa.array([row[c]], pa.float64()) for c in COLUMNS})

    some = grid.where("mass > 0").select(group, "ix", "iy", "mass")
    return some.groupBy(group).applyInArrow(run, f"{group} {kind}, " + ", ".join(f"{c} double" for c in COLUMNS))


def spanning_edges(p: np.ndarray) -> np.ndarray:
    """Lengths of the edges of a minimum spanning tree of points in the plane.

    Rounds of Boruvka: each component takes its shortest edge to another. The points are sorted along their longer axis,
    and a point looks at others in that order only as far as their gap along it is below the best edge of its component.
    """
    n = len(p)
    p = p[np.argsort(p[:, int(np.ptp(p[:, 0]) < np.ptp(p[:, 1]))], kind="stable")] if n else p
    line = p[:, int(np.ptp(p[:, 0]) < np.ptp(p[:, 1]))] if n else np.zeros(0)
    comp, out = np.arange(n), []
    while n and comp.max() > 0:
        m = comp.max() + 1
        best, low, high = np.full(m, np.inf), np.full(m, n), np.full(m, n)
        for sign in (1, -1):
            active, step = np.arange(n), 0
            while len(active):
                step += 1
                active = active[(active + sign * step >= 0) & (active + sign * step < n)]
                other = active + sign * step
                near = np.abs(line[other] - line[active]) <= best[comp[active]]
                active, other = active[near], other[near]
                apart = comp[active] != comp[other]
                i, j = active[apart], other[apart]
                d, c = np.hypot(*(p[i] - p[j]).T), comp[i]
                use = d <= best[c]
                i, j, d, c = i[use], j[use], d[use], c[use]
                lo, hi = np.minimum(i, j), np.maximum(i, j)
                by = np.lexsort((hi, lo, d, c))  # ties by place, so that no round closes a circle
                by = by[np.concatenate([[True], c[by][1:] != c[by][:-1]])] if len(by) else by
                d, c, lo, hi = d[by], c[by], lo[by], hi[by]
                better = (d < best[c]) | (lo < low[c]) | ((lo == low[c]) & (hi < high[c]))
                c = c[better]
                best[c], low[c], high[c] = d[better], lo[better], hi[better]
        edges = np.unique(np.stack([low, high], 1), axis=0)
        out.append(np.hypot(*(p[edges[:, 0]] - p[edges[:, 1]]).T))
        top = np.arange(m)
        while True:  # components that edges join get one name
            a, b = top[comp[edges[:, 0]]], top[comp[edges[:, 1]]]
            if (a == b).all():
                break
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while (top[top] != top).any():
                top = top[top]
        comp = np.unique(top[comp], return_inverse=True)[1]
    return np.concatenate(out) if out else np.zeros(0)


def spanning_gaps(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """95th percentile over the median of the edges of each group's minimum spanning tree, over all its points.

    NULL where the median edge has no length. A group is one task: two numbers for each point.
    """
    kind = points.schema[group].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        e = spanning_edges(np.stack([t.column(x).to_numpy(), t.column(y).to_numpy()], 1).astype(float))
        mid = float(np.median(e)) if len(e) else 0.0
        gap = float(np.percentile(e, 95) / mid) if mid > 1e-12 else None
        return pa.table({group: pa.array([key[0].as_py()], t.schema.field(group).type), "n": [t.num_rows], "gap": pa.array([gap], pa.float64())})

    some = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return some.groupBy(group).applyInArrow(run, f"{group} {kind}, n long, gap double")


def shape_row(points: DataFrame, group: str, id_: str, x: str, y: str, *, size: int = 32, sigma: float = 1.0, k: int = 15, least: int = 10) -> DataFrame:
    """A row of all plane metrics for each group of points(group, id, year, x, y) about its median, with a status.

    Groups with fewer than `least` points are skipped and keep their row.
    """
    n = points.groupBy(group).agg(F.count("*").alias("n"))
    some = points.join(n.where(F.col("n") >= least).select(group), group, "left_semi")
    at = settle(features.centred(some, [group], x, y))
    grid = settle(density.smoothed(density.cells(at, [group], x, y, -1.5, 1.5, size), [group], size, sigma))
    place = [F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    rows = at.select(F.col(group), F.col(id_).alias("src"), *place).join(kth_distances(at, group, x, y, k), ["g", "x", "y"])
    near = settle(rows.select(group, "src", "d", F.lit(k).alias("rank")))
    parts = [
        features.radial_shape(some, [group], x, y).drop("n"), density.concentration(grid, [group], size), density_shape(grid, group, size), spanning_gaps(at, group, x, y).drop("n"),
        summaries.kth_neighbour(near, group, k).drop("n"), summaries.yearly_path(at, [group], x, y), density.entropy_trend(at, [group], x, y, -1.5, 1.5, size),
    ]
    out = n
    for t in parts:
        out = out.join(t, group, "left")
    return out.withColumn("status", F.when(F.col("n") >= least, "completed").otherwise("skipped"))


def tiled(places: DataFrame, size: int) -> DataFrame:
    """places(g, x, y, ...), none twice, with a tile each: strips of a group by x, cut by y into tiles of `size` places."""
    at = F.struct("g", "x", "y")
    many = places.groupBy("g").agg(F.count("*").alias("many"))
    wide = F.ceil(F.sqrt(F.col("many") / size)) * size  # places of a strip
    rows = numbered(places.withColumn("at", at), ["g", "x", "y"], "at", "place")
    rows = rows.join(rows.groupBy("g").agg(F.min("place").alias("low")), "g").join(many, "g")
    rows = written(rows.withColumn("strip", F.floor((F.col("place") - F.col("low")) / wide)).drop("place", "low", "many"))
    rows = numbered(rows, ["g", "strip", "y", "x"], "at", "place")
    rows = rows.join(rows.groupBy("g", "strip").agg(F.min("place").alias("low")), ["g", "strip"])
    return written(rows.withColumn("tile", F.concat_ws("|", "strip", F.floor((F.col("place") - F.col("low")) / size))).drop("at", "place", "low", "strip"))


def _nearest(k: int, found: str, last: bool):
    """Of the places asked about in a tile: distances to its k nearest points, without the asking point itself.

    last: the farthest of them alone, or infinity where the tile has fewer.
    """

    def run(t: pa.Table) -> pa.Table:
        x, own, n = np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], 1), t.column("own").to_numpy(zero_copy_only=False), t.column("n").to_numpy()
        held, many, out, rows = x[own], np.minimum(n[own], k + 1), [], np.cumsum(own) - 1
        for a in range(0, len(x), 512):
            gap = np.sqrt(((x[a : a + 512, None] - held[None]) ** 2).sum(-1))
            if gap.shape[1] > k + 1:
                by = np.argpartition(gap, k, axis=1)[:, : k + 1]
                by = np.take_along_axis(by, np.argsort(np.take_along_axis(gap, by, 1), axis=1), 1)
            else:
                by = np.argsort(gap, axis=1)
            for i, to in enumerate(by):
                left = many[to] - (own[a + i] & (to == rows[a + i]))
                d = np.repeat(gap[i, to], left)[:k]
                out.append([d[-1] if len(d) == k else np.inf] if last else d)
        keys = t.select(["g", "x", "y"])
        return keys.append_column(found, pa.array([v[0] for v in out], pa.float64()) if last else pa.array(out, pa.list_(pa.float64())))

    return run


def kth_distances(rows: DataFrame, group: str, x: str, y: str, k: int, *, size: int = 1024) -> DataFrame:
    """(g, x, y, d) of each place of points in the plane: the distance of its points to their k-th other of the group.

    The last one where there are fewer; a point alone has none. Points without both numbers are left out. Exact: a tile of `size` places bounds the distance of each
    of its own, and only tiles whose box is not farther are asked.
    """
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    places = written(rows.groupBy(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")))
    kind = f"g {places.schema['g'].dataType.simpleString()}, x double, y double"
    tiles = tiled(places, size)
    own = tiles.withColumn("own", F.lit(True))
    reach = written(tiles.join(own.groupBy("g", "tile").applyInArrow(_nearest(k, "r", True), f"{kind}, r double"), ["g", "x", "y"]))
    boxes = reach.groupBy("g", "tile").agg(F.max("r").alias("r"), *(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    beyond = lambda c, low, high: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0))
    apart = [F.greatest(F.col(f"min_{c}") - F.col(f"to_max_{c}"), F.col(f"to_min_{c}") - F.col(f"max_{c}"), F.lit(0.0)) for c in "xy"]
    other = boxes.select("g", F.col("tile").alias("to"), *(F.col(f"{f}_{c}").alias(f"to_{f}_{c}") for c in "xy" for f in ("min", "max")))
    pairs = boxes.join(other, "g").where((F.col("tile") != F.col("to")) & (F.sqrt(sum(v * v for v in apart)) <= F.col("r"))).drop("r")
    gaps = [beyond(c, f"to_min_{c}", f"to_max_{c}") for c in "xy"]
    guests = reach.join(pairs, ["g", "tile"]).where(F.sqrt(sum(v * v for v in gaps)) <= F.col("r"))
    asked = own.select("g", "tile", "x", "y", "n", "own").union(guests.select("g", "to", "x", "y", "n", F.lit(False)))
    near = asked.groupBy("g", "tile").applyInArrow(_nearest(k, "d", False), f"{kind}, d array<double>")
    d = F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k)
    return near.groupBy("g", "x", "y").agg(d.alias("d")).where(F.size("d") > 0).withColumn("d", F.element_at("d", -1))
