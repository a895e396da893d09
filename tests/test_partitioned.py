import numpy as np
import pytest

from cloudform.operators import models, partitioned


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.4, (80, 3)) for c in ([0, 0, 100], [3, 0, 100], [0, 4, 100])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 0.0])], "id long, x array<double>")
    return x, df.repartition(7)


def plain(x, c):
    for _ in range(100):
        y = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[y == j].mean(0) if (y == j).any() else c[j] for j in range(len(c))])
    return c, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum()


def test_objective_as_in_one_task_from_the_same_start(spark, data):
    x, df = data
    start = x[[0, 1, 2, 90]]
    want, cost = plain(x, start)
    points = partitioned._usable(df, "id", "x")
    got, total = partitioned.lloyd(points, start)
    assert got == pytest.approx(want) and total == pytest.approx(cost, rel=1e-6)
    rows = partitioned.kmeans_clusters(df, "id", "x", 4, start=start).collect()
    assert len(rows) == len(x) and sum(r.d2 for r in rows) == pytest.approx(cost, rel=1e-6)


def test_seeding_finds_the_blobs_and_reruns_agree(spark, data):
    x, df = data
    rows = {r.id: r.cluster for r in partitioned.kmeans_clusters(df, "id", "x", 3, restarts=2).collect()}
    y = np.array([rows[i] for i in range(len(x))])
    assert models.rand_index(y, np.repeat([0, 1, 2], 80)) == pytest.approx(1)
    again = {r.id: r.cluster for r in partitioned.kmeans_clusters(df.repartition(2), "id", "x", 3, restarts=2).collect()}
    assert again == rows


def test_mixture_as_in_one_task(spark, data):
    x, df = data
    rows = partitioned.mixture_clusters(df, "id", "x", 3).collect()
    y, p, bic, aic = models.mixture(x, 3)
    got = {r.id: r for r in rows}
    assert len(rows) == len(x) and models.rand_index(np.array([got[i].cluster for i in range(len(x))]), y) == pytest.approx(1)
    assert [got[i].probability for i in range(len(x))] == pytest.approx(p, abs=1e-4)
    assert rows[0].bic == pytest.approx(bic, rel=1e-5) and rows[0].aic == pytest.approx(aic, rel=1e-5)


def test_few_rows_and_none(spark):
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], "id long, x array<double>")
    assert sorted(r.d2 for r in partitioned.kmeans_clusters(two, "id", "x", 9).collect()) == [0, 0, 0]
    assert partitioned.kmeans_clusters(two.limit(0), "id", "x", 2).count() == 0 and partitioned.mixture_clusters(two.limit(0), "id", "x", 2).count() == 0


def test_restarts_share_their_passes(spark, data, monkeypatch):
    x, df = data
    points = partitioned._usable(df, "id", "x")
    starts, calls, real = [x[[0, 1, 2, 90]], x[[0, 100, 200]], x[:2]], [], partitioned._summed
    monkeypatch.setattr(partitioned, "_summed", lambda *a: calls.append(1) or real(*a))
    alone, needed = [], []
    for s in starts:
        alone.append(partitioned.lloyd(points, s))
        needed.append(len(calls) - sum(needed))
    calls.clear()
    got = partitioned.lloyds(points, starts)
    assert len(calls) == max(needed) < sum(needed)
    for (c, cost), (want, least) in zip(got, alone, strict=True):
        assert c == pytest.approx(want) and cost == pytest.approx(least)
