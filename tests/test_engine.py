import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudform.operators import cloud, cluster, corpus, temporal
from cloudform.sources.files import safe_url, table_name


def rows(spark, x, year=2000):
    return cloud.unit_rows(spark.createDataFrame([(i, 0, year, list(map(float, v))) for i, v in enumerate(x)], "id long, g int, year int, embedding array<double>"))


def test_dispersion_and_neighbours_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 6))
    r = rows(spark, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u.mean(0)
    d = 1 - u @ c / np.linalg.norm(c)
    got = cloud.dispersion(r, ["g"]).first()
    assert got.n == 40 and got.median_distance == pytest.approx(np.median(d)) and got.p90_distance == pytest.approx(np.percentile(d, 90))
    full = 1 - u @ u.T
    np.fill_diagonal(full, np.inf)
    want = {(i, int(j)) for i in range(40) for j in np.argsort(full[i])[:3]}
    assert {(a.src, a.dst) for a in cloud.neighbours(r, "g", "id", 3).collect()} == want


def test_spectrum_against_svd(spark):
    x = np.random.default_rng(1).normal(size=(30, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.linalg.svd(u - u.mean(0), compute_uv=False) ** 2
    got = cloud.spectrum(rows(spark, x), "g").first()
    assert got.top1 == pytest.approx(s[0] / s.sum()) and got.participation == pytest.approx(1 / ((s / s.sum()) ** 2).sum())


def test_zero_and_null_vectors_go(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 2.0])], "id long, embedding array<double>")
    assert [r.id for r in cloud.unit_rows(df).collect()] == [3]


def test_gini(spark):
    df = spark.createDataFrame([("a", 3.0)] * 4 + [("b", 0.0)] * 3 + [("b", 12.0)] + [("c", 0.0)] * 2, "g string, x double")
    assert {r.g: round(r.gini, 9) for r in cloud.gini(df, "g", "x").collect()} == {"a": 0.0, "b": 0.75, "c": 0.0}


def test_windows_and_paths(spark):
    assert [r.window_label for r in temporal.windows(spark, 2000, 2011).collect()] == ["2000-2004", "2005-2009", "2010-2011"]
    a = [np.deg2rad(t) for t in (0, 30, 60, 90, 120)]
    cen = spark.createDataFrame([(1, i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(a)], "e int, window_index int, centroid array<double>")
    p = temporal.paths(cen, "e").first()
    assert p.drift == pytest.approx(1.5) and p.path == pytest.approx(4 * (1 - np.cos(np.pi / 6))) and p.directness == pytest.approx(np.sqrt(3) / (8 * np.sin(np.pi / 12)))


def test_redistribution(spark):
    df = spark.createDataFrame([("s", 2010, 0), ("s", 2011, 100)] + [("s", y, 1000) for y in range(2012, 2020)], "k string, year int, n long")
    got = {r.year: r.quota for r in corpus.redistribute(df, "k", "n", 3000, 300).collect()}
    assert sum(got.values()) == 3000 and got[2010] == 0 and got[2011] == 100


def test_sample_plan_and_index(spark):
    df = spark.createDataFrame([(1000,), (400,), (120,), (0,)], "n long")
    assert [(r.planned, r.method, r.first_request) for r in corpus.sample_plan(df, "n", 300, 1.75).collect()] == [(300, "sample", 525), (300, "sample", 400), (120, "download_all", 120), (0, "skip", 0)]
    t = spark.createDataFrame([(1, "b a b c")], "id int, text string")
    assert corpus.inverted_index(t, "id", "text").select(corpus.rebuilt("index").alias("t")).first().t == "b a b c"
    gap = spark.sql("SELECT map('a', array(0), 'b', array(2)) AS i")
    assert gap.select(corpus.rebuilt("i").alias("t")).first().t is None
    assert spark.createDataFrame([("naïve café",), (None,)], "t string").select(corpus.token_count("t").alias("n")).agg(F.sum("n")).first()[0] == 2


def test_clusters(spark):
    x = np.array([[0, 0], [0, 0.1], [5, 5], [5, 5.1], [5.1, 5]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for m in ("ward", "average", "complete"):
        y = cluster.linked(d, 2, m)
        assert y[0] == y[1] and len(set(y[2:])) == 1 and y[0] != y[2]
    assert cluster.adjusted_mutual_information(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == pytest.approx(1)
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "B"), (2, "C")], "c int, d string")
    assert cluster.purity(df, "c", "d").first().purity == pytest.approx(3 / 5)


def test_guards():
    with pytest.raises(ValueError):
        table_name("a;b")
    assert "secret" not in safe_url("http://x/?api_key=secret&a=1")


def test_entry_imports():
    import __spark_entry__ as e

    assert "cloud_dispersion" in e.queries()
