import numpy as np
import pytest

from cloudform.operators import cloud, maps
from cloudform.operators.models import gaps
from cloudform.operators.projections import trustworthiness


def blobs(spark, sizes, d=12, seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=d) * 3 + r.normal(0, 0.5, (n, d)) for n in sizes])
    label = np.repeat(np.arange(len(sizes)), sizes)
    df = spark.createDataFrame([("all", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, embedding array<double>")
    rows = cloud.unit_rows(df)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return rows, u, label


def places(df, n):
    got = {r.id: (r.x, r.y) for r in df.collect()}
    assert set(got) == set(range(n)) and np.isfinite(list(got.values())).all()
    return np.array([got[i] for i in range(n)])


def apart(y, label):
    """The share of vertices whose nearest other in the map has their label."""
    e = gaps(y)
    np.fill_diagonal(e, np.inf)
    return (label[e.argmin(1)] == label).mean()


def test_curve_and_widths(spark):
    a, b = maps.curve()
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))
    d = np.sort(np.random.default_rng(3).random((6, 10)), 1)
    s = [r[0] for r in spark.createDataFrame([(v.tolist(),) for v in d], "d array<double>").select(maps._width("d")).collect()]
    assert np.exp(-(d - d[:, :1]) / np.array(s)[:, None]).sum(1) == pytest.approx(np.full(6, np.log2(11)))


def test_fuzzy_edges_by_hand(spark):
    near = spark.createDataFrame([("g", 1, 2, 0.1), ("g", 1, 3, 0.3), ("g", 2, 1, 0.1), ("g", 2, 3, 0.2), ("g", 3, 2, 0.2), ("g", 3, 1, 0.3)], "g string, src long, dst long, d double")
    got = {(r.a, r.b): r.w for r in maps.fuzzy_edges(near, "g").collect()}
    far = np.log2(3) - 1  # of two neighbours the nearer has 1, so the other has the rest
    assert got == {(1, 2): pytest.approx(1), (1, 3): pytest.approx(2 * far - far**2), (2, 3): pytest.approx(1)}


@pytest.mark.parametrize("block", [1 << 14, 100])
def test_neighbour_map_keeps_neighbourhoods(spark, block):
    rows, u, label = blobs(spark, [60, 50, 40, 90])
    near = cloud.neighbours(rows, "g", "id", 10).cache()
    how = dict(rounds=6, epochs=20) if block > 100 else dict(rounds=12, epochs=5)
    y = places(maps.neighbour_map(rows, near, "g", "id", block=block, **how), len(u))
    assert trustworthiness(gaps(u), y, 10) > 0.9 and apart(y, label) > 0.97
    if block > 100:
        again = places(maps.neighbour_map(rows, near, "g", "id", block=block, **how), len(u))
        assert again == pytest.approx(y, abs=1e-6)


def test_diffusion_map_of_a_branching_path(spark):
    """Three arms that leave one point: landmarks and their extension keep each arm's order."""
    r = np.random.default_rng(5)
    t = np.repeat(np.linspace(0.05, 1, 60), 3)
    arm = np.tile([0, 1, 2], 60)
    x = np.zeros((180, 8))
    x[:, 7] = 1
    x[np.arange(180), arm] = t
    x += r.normal(0, 0.005, x.shape)
    rows = cloud.unit_rows(spark.createDataFrame([("a" if i % 180 == i else "b", i % 180, v.tolist()) for i, v in enumerate(x)], "g string, id long, embedding array<double>"))
    near = cloud.neighbours(rows, "g", "id", 8).cache()
    for landmarks in (1000, 50):
        y = places(maps.diffusion_map(rows, near, "g", "id", landmarks=landmarks).select("id", "x", "y"), 180)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert trustworthiness(gaps(u), y, 10) > 0.85
        tips = np.array([y[(arm == a) & (t > 0.9)].mean(0) for a in range(3)])
        assert gaps(tips)[np.triu_indices(3, 1)].min() > 0.3 * gaps(y).max()


def test_walk_sums_to_one_and_matches_the_matrix(spark):
    rows, u, _ = blobs(spark, [15, 15], 6, 1)
    near = cloud.neighbours(rows, "g", "id", 4)
    k = {(r.src, r.dst): r.k for r in maps.walk(near, "g", 40.0).collect()}
    d = gaps(u)
    np.fill_diagonal(d, np.inf)
    want = np.zeros((30, 30))
    for i in range(30):
        for j in np.argsort(d[i])[:4]:
            want[i, j] = np.exp(-((d[i, j] / np.sort(d[i])[3]) ** 40))
    want = (want + want.T) / 2
    got = np.zeros((30, 30))
    for (i, j), v in k.items():
        got[i, j] = v
    assert got == pytest.approx(want, abs=1e-6)


def test_small_and_null_groups(spark):
    data = [("one", 1, [1.0, 0.0]), ("two", 2, [1.0, 0.0]), ("two", 3, [0.0, 1.0]), ("same", 4, [1.0, 1.0]), ("same", 5, [1.0, 1.0]), ("same", 6, [1.0, 1.0]), (None, 7, [1.0, 0.5])]
    rows = cloud.unit_rows(spark.createDataFrame(data, "g string, id long, embedding array<double>"))
    near = cloud.neighbours(rows.where("g is not null"), "g", "id", 3)
    for got in (maps.neighbour_map(rows, near, "g", "id", rounds=2, epochs=2), maps.diffusion_map(rows, near, "g", "id")):
        found = got.collect()
        assert sorted(r.id for r in found) == [1, 2, 3, 4, 5, 6] and all(np.isfinite([r.x, r.y]).all() for r in found)
    assert maps.diffusion_map(rows.limit(0), near.limit(0), "g", "id").count() == 0
