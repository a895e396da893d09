import numpy as np
import pytest

from cloudform.operators import projections, together
from cloudform.operators.models import gaps


def cloud_of(n, d=10, seed=0, parts=3):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=d) * 8 + r.normal(size=(n // parts, d)) * np.linspace(1, 0.3, d) for _ in range(parts)])


def test_pieces_agree_with_the_whole(monkeypatch):
    x = cloud_of(120)
    x[5] = x[9] = x[40]  # copies
    monkeypatch.setattr(together, "PIECE", 700)
    monkeypatch.setattr(together.pieces, "__defaults__", (700,))
    points, team, d = together.Points(x), together.Team(), gaps(x)
    y = projections.pca(x)
    got = together.isomap(points, y, team)
    assert projections.fixed_signs(got) == pytest.approx(projections.isomap(d), abs=1e-6)
    with together.Spool() as p:
        together.probabilities(points, 20.0, team, p)
        p.rewind()
        mine = np.concatenate([p.next((b - a, 120), np.float32) for a, b in together.pieces(0, 120, 120)])
        want = projections.affinities(d**2, 20.0)
        assert mine[~np.eye(120, dtype=bool)] == pytest.approx(want[~np.eye(120, dtype=bool)], rel=1e-5, abs=1e-11)
        p.rewind()
        pull, total = together.forces(y, 0, 120, p)
    w = 1 / (1 + gaps(y) ** 2)
    np.fill_diagonal(w, 0)
    assert total == pytest.approx(w.sum(), rel=1e-5)
    for f, at in ((want * w, slice(0, 2)), (w * w, slice(2, 4))):
        assert pull[:, at] == pytest.approx(f.sum(1)[:, None] * y - f @ y, rel=1e-3, abs=1e-4 * np.abs(f @ y).max())
    short = together.tsne([points], [projections.pca(x)], team, rounds=5)[0]  # rounding grows from round to round
    assert short == pytest.approx(projections.tsne(x, rounds=5), abs=1e-3 * np.abs(short).max())
    maps = [y, np.round(y), np.zeros((120, 2))]
    assert together.trusts(points, maps, team) == pytest.approx([projections.trustworthiness(d, m) for m in maps])


def test_graphs_that_fall_apart():
    x = np.repeat(np.random.default_rng(1).normal(size=(4, 3)), 20, 0)  # only copies are near
    points, team = together.Points(x), together.Team()
    i, j, length = together.graph(points, 5, team)
    assert not together.parts(80, i, j).any() and (length > 1e-9).sum() == 3
    assert (together.widths(points.levels(0, 80), np.arange(80), 10.0)[2] == 19).all()


def test_copies_of_one_vector():
    r = np.random.default_rng(4)
    x = np.concatenate([np.repeat(r.normal(size=(1, 5)), 150, 0), r.normal(size=(60, 5))])[r.permutation(210)]
    points, team, d = together.Points(x), together.Team(), gaps(x)
    assert gaps(together.isomap(points, projections.pca(x), team)) == pytest.approx(gaps(projections.isomap(d)), abs=1e-6)
    y = projections.tsne(x, rounds=20)
    assert np.isfinite(y).all()  # a row's own place overflowed
    assert together.trusts(points, [y], team) == pytest.approx([projections.trustworthiness(d, y)])
    found = together.maps([np.ones((50, 3))], projections.METHODS, team, projections.pca, projections.fixed_signs)[0]
    assert set(found) == set(projections.METHODS) and all((y == 0).all() for y, _ in found.values())


def test_large_groups_are_mapped_whole(spark):
    data = [(g, i * 7 % 1000, v.tolist()) for g, n in (("a", 90), (None, 60), ("c", 30), ("d", 1)) for i, v in enumerate(cloud_of(n, seed=n, parts=3 if n > 3 else 1))]
    rows = spark.createDataFrame(data, "g string, id long, v array<double>").repartition(5)
    one = {(r.g, r.method, r.id): r for r in projections.projections(rows, "g", "id", "v").collect()}
    for batch in (1000, 100):
        all_ = {(r.g, r.method, r.id): r for r in projections.projections(rows, "g", "id", "v", alone=40, batch=batch).collect()}
        assert set(all_) == set(one) and len(one) == 4 * len(data)
        for k, r in all_.items():
            assert r.n == one[k].n
            if k[1] != "tsne":
                assert (r.x, r.y) == (pytest.approx(one[k].x, abs=1e-6), pytest.approx(one[k].y, abs=1e-6))
                assert r.trustworthiness == one[k].trustworthiness or r.trustworthiness == pytest.approx(one[k].trustworthiness)
            elif r.trustworthiness is not None:
                assert r.trustworthiness == pytest.approx(one[k].trustworthiness, abs=0.03)


def test_no_row_is_left_out_by_default(spark):
    x = np.random.default_rng(2).normal(size=(3100, 3))
    rows = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<double>")
    got = projections.projections(rows, "g", "id", "v", ("pca",)).toPandas().sort_values("id")
    assert len(got) == 3100 and (got.n == 3100).all()
    assert got[["x", "y"]].to_numpy() == pytest.approx(projections.pca(x), abs=1e-9)
    with pytest.raises(ValueError):
        projections.projections(rows, "g", "id", "v", ("umap",))
