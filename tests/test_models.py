import numpy as np
import pytest

from cloudform.operators import models as M
from cloudform.operators import shapes as S


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    return np.concatenate([rng.normal(c, 0.1, (12, 3)) for c in ([0, 0, 1], [3, 0, 0], [0, 4, 0])]), np.repeat([0, 1, 2], 12)


@pytest.mark.parametrize("method", ["ward", "average", "average:cosine", "complete", "kmeans", "mixture", "spectral"])
def test_methods_find_blobs(blobs, method):
    assert M.rand_index(M.labelled(blobs[0], 3, method), blobs[1]) == pytest.approx(1)


def test_silhouette_by_hand(blobs):
    x, y = blobs
    d, want = M.gaps(x), []
    for i in range(len(x)):
        own = d[i][(y == y[i]) & (np.arange(len(x)) != i)].mean()
        other = min(d[i][y == c].mean() for c in set(y) - {y[i]})
        want.append((other - own) / max(own, other))
    assert M.mean_silhouette(d, y) == pytest.approx(np.mean(want))
    assert M.mean_silhouette(d, np.zeros(len(x), int)) is None


def table(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(-1, None)], "id long, x array<double>")


def test_grid_and_stability(spark, blobs):
    got = {(r.method, r.k): r for r in M.model_grid(table(spark, blobs[0]), "id", "x", ["ward", "kmeans"], [2, 3]).collect()}
    assert got["ward", 3].sizes == "12;12;12" and got["ward", 3].silhouette > got["ward", 2].silhouette and got["kmeans", 3].n == 36
    runs = M.stability(table(spark, blobs[0]), "id", "x", "ward", 3, runs=4).collect()
    assert len(runs) == 4 and all(r.ari == pytest.approx(1) and r.ami == pytest.approx(1) and r.n == 29 for r in runs)


def test_principal_scores_against_svd(spark, blobs):
    x = blobs[0]
    c = x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    got = sorted(M.principal_scores(table(spark, x), "id", "x").collect(), key=lambda r: r.id)
    assert np.abs([r.scores for r in got]) == pytest.approx(np.abs(c @ v[:2].T)) and got[0].shares == pytest.approx((s**2 / (s**2).sum())[:2])
    assert len(M.principal_axes(table(spark, x), "x", n=None, share=0.99).first().axes) == 2


def test_scaling_restores_distances(spark):
    p = np.random.default_rng(4).normal(size=(6, 2))
    pairs = [("l", str(i), str(j), float(np.linalg.norm(p[i] - p[j]))) for i in range(6) for j in range(i + 1, 6)]
    got = {r.entity: np.array(r.point) for r in M.classical_scaling(spark.createDataFrame(pairs, "level string, a string, b string, d double"), "level", "d").collect()}
    assert all(np.linalg.norm(got[a] - got[b]) == pytest.approx(d) for _, a, b, d in pairs)


def test_mixture_has_probabilities(spark, blobs):
    rows = M.mixture_members(table(spark, blobs[0]), "id", "x", 3).collect()
    assert len(rows) == 36 and all(0.99 < r.probability <= 1 + 1e-9 for r in rows) and rows[0].bic > rows[0].aic


def flood(mask, near):
    left, n = set(map(tuple, np.argwhere(mask))), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            i, j = todo.pop()
            for a, b in near:
                if (i + a, j + b) in left:
                    left.remove((i + a, j + b))
                    todo.append((i + a, j + b))
    return n


def test_regions_against_flood_fill():
    rng = np.random.default_rng(6)
    for near in (S.NEAR4, S.NEAR8):
        for p in (0.3, 0.5, 1.0, 0.0):
            mask = rng.random((9, 11)) < p
            lab = S.regions(mask, near)
            assert len(np.unique(lab[lab > 0])) == flood(mask, near) and ((lab > 0) == mask).all()


def test_shape_of_a_ring(spark):
    ring = [(0, i, j, 1.0) for i in range(1, 6) for j in range(1, 6) if i in (1, 5) or j in (1, 5)]
    r = S.density_shape(spark.createDataFrame(ring + [(1, 2, 2, None)], "g int, ix int, iy int, mass double"), "g", 8, core=1.0, support=1.0).collect()
    assert len(r) == 1 and (r[0].n_holes, r[0].area, r[0].perimeter, r[0].n_components, r[0].n_peaks) == (1, 16, 32, 1, 1) and r[0].solidity == pytest.approx(16 / 25)


def test_hull_and_spanning_tree(spark):
    assert S.hull_area(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == 4 and S.hull_area(np.array([(0, 0), (1, 1)])) == 0
    p = np.random.default_rng(8).normal(size=(30, 2))
    d, root, want = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), list(range(30)), 0.0
    for w, i, j in sorted((d[i, j], i, j) for i in range(30) for j in range(i)):
        if root[i] != root[j]:
            want, old = want + w, root[i]
            root = [root[j] if v == old else v for v in root]
    assert S.spanning_edges(p).sum() == pytest.approx(want)
    one = spark.createDataFrame([(0, 1, 0.0, 0.0)], "g int, id int, x double, y double")
    assert S.spanning_gaps(one, "g", "x", "y").first().gap is None


def test_stability_query_runs_all(spark):
    from cloudform.plans.queries_models import REGISTRY

    assert REGISTRY["cluster_stability"](spark, "/root/testdata/sf0.001").count() == 100
