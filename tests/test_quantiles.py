import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudform.operators import cloud, entities
from cloudform.operators.quantiles import group_percentiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def test_selection_in_rounds_against_numpy(spark):
    r = np.random.default_rng(0)
    groups = {"even": r.random(3000), "ties": r.integers(0, 4, 3000) * 1.0, "one": np.full(700, 2.5), "skewed": np.exp(r.normal(0, 6, 2000)), "huge": np.array([-1.7e308, 1.7e308, 0.0] * 200), "small": r.random(7), None: r.normal(size=900), "near": 1 + np.arange(600) * 2.3e-16}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for most, bins in ((100, 1024),):
        got = {x.g: x.q for x in group_percentiles(df, ["g"], "v", SHARES, most=most, bins=bins).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            lo, hi = (np.quantile(x, SHARES, method=m) for m in ("lower", "higher"))
            assert (np.array(got[g]) >= lo).all() and (np.array(got[g]) <= hi).all(), g
            if g != "huge":
                assert got[g] == pytest.approx(list(np.quantile(x, SHARES)), rel=1e-12), g
    assert group_percentiles(df.limit(0), ["g"], "v", SHARES).count() == 0


def test_rounds_read_no_group_whole(spark, monkeypatch):
    """Dispersion and neighbours of groups over the bound, with and without known sizes."""
    monkeypatch.setattr(cloud, "MOST", 20)
    monkeypatch.setattr(cloud.group_percentiles, "__kwdefaults__", cloud.group_percentiles.__kwdefaults__ | {"most": 20})
    x = np.random.default_rng(1).normal(size=(400, 5)) + 1
    df = cloud.unit_rows(spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, embedding array<double>"))
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for how in (None, sizes):
        for row in cloud.dispersion(df, ["g"], how).collect():
            own = u[np.arange(400) % 3 == row.g]
            c = own.mean(0)
            d = 1 - own @ c / np.linalg.norm(c)
            assert (row.n, row.median_distance, row.p90_distance) == (len(own), pytest.approx(np.median(d)), pytest.approx(np.quantile(d, 0.9)))
    near = cloud.neighbours(df, "g", "id", 4)
    for row in cloud.neighbour_stats(near, "g").collect():
        d = np.sort(1 - u[np.arange(400) % 3 == row.g] @ u[np.arange(400) % 3 == row.g].T, axis=1)[:, 1:5]
        assert row.median_knn == pytest.approx(np.median(d)) and row.p90_knn == pytest.approx(np.quantile(d, 0.9))


@pytest.mark.parametrize("held", [1 << 26, 9000])
def test_spectrum_of_many_groups_against_svd(spark, monkeypatch, held):
    monkeypatch.setattr(cloud, "HELD", held)
    monkeypatch.setattr(cloud, "TILE", 100)
    r = np.random.default_rng(2)
    x = {g: r.normal(size=(int(r.integers(1, 60)), 24)) * r.random(24) for g in range(40)}
    rows = [(g, i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)]
    df = cloud.unit_rows(spark.createDataFrame(rows, "g int, id long, embedding array<double>").repartition(3))
    for some in (df, df.where("g < 5")):  # dealt by group, and not
        got = {row.g: row for row in cloud.spectrum(some, "g").collect()}
        assert set(got) == {row.g for row in some.select("g").distinct().collect()}
        for g, row in got.items():
            u = x[g] / np.linalg.norm(x[g], axis=1, keepdims=True)
            s = np.linalg.svd(u - u.mean(0), compute_uv=False) ** 2
            assert row.n == len(u)
            if len(u) > 2:
                assert (row.top1, row.participation) == (pytest.approx(s[0] / s.sum()), pytest.approx(s.sum() ** 2 / (s**2).sum()))


def test_numbers_have_no_gaps_whatever_columns_are_asked_for(spark):
    n = 500_000
    df = spark.range(n, numPartitions=7).select(F.xxhash64("id").alias("id"), (F.col("id") % 1000).alias("g"), F.repeat(F.lit("x"), 40).alias("text"))
    out = entities.numbered(df, ["g"], "id")
    few = out.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()
    assert tuple(few) == (n, n, 0, n - 1)
    all_ = out.agg(F.sum(F.length("text")), F.count_distinct("row_id"), F.max("row_id")).first()
    assert tuple(all_) == (40 * n, n, n - 1)
    assert out.where("g = 0").agg(F.max("row_id")).first()[0] == n // 1000 - 1
