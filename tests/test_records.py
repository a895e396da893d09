import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudform.operators import cloud, features, records, typology


def points(spark, x, cluster):
    return spark.createDataFrame([(i, int(c), list(map(float, v))) for i, (v, c) in enumerate(zip(x, cluster, strict=True))], "id long, c int, u array<double>")


def test_short_ids_and_slugs(spark):
    df = spark.createDataFrame([(" https://a.org/W12/ ",), ("T3",), ("//",), ("",), (None,)], "u string")
    assert [r[0] for r in df.select(records.short_id("u")).collect()] == ["W12", "T3", None, None, None]
    assert spark.range(1).select(records.slug(F.lit(7), F.lit(" A & B! "))).first()[0] == "7_a_b"


def test_first_failed_check_is_the_reason(spark):
    df = spark.createDataFrame([(1, "en"), (None, "de"), (2, None), (3, "de")], "id int, lang string")
    why = records.acceptance({"id": F.col("id").isNotNull(), "language": F.col("lang") == "en"})
    assert [r[0] for r in df.select(why).collect()] == [None, "id", "language", "language"]


def test_flags_under_other_names(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "old int")
    assert [r[0] for r in df.select(records.first_present(df, "flag", "old")).collect()] == [True, False, None]
    with pytest.raises(ValueError, match="none of these"):
        records.first_present(df, "flag")


def test_union_keeps_the_base(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w"), (3, "q")], "k int, v string")
    assert sorted(map(tuple, records.union_new(a, b, "k", ["v"]).collect())) == [(1, "x"), (2, "y"), (3, "q")]


def test_mismatches_treat_nulls_as_equal(spark):
    a, b = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string"), spark.createDataFrame([(1, None), (2, None), (3, "b")], "k int, v string")
    assert records.mismatches(a, b, "k", ["v"]).first().n == 1


def test_completion_of_an_empty_plan(spark):
    none = spark.createDataFrame([], "k int")
    assert tuple(records.completion(none, none, ["k"]).first()) == (0, 0, 0.0, "incomplete")


def test_indices_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1, 2], 20)
    x = rng.normal(size=(60, 4)) + 3 * np.eye(4)[y]
    p = points(spark, x, y)
    centres = np.array([x[y == k].mean(0) for k in range(3)])
    between = sum(20 * ((c - x.mean(0)) ** 2).sum() for c in centres)
    within = sum(((x[y == k] - centres[k]) ** 2).sum() for k in range(3))
    assert typology.calinski_harabasz(p, "c", "u").first().calinski_harabasz == pytest.approx(between / 2 / (within / 57))
    s = np.array([np.linalg.norm(x[y == k] - centres[k], axis=1).mean() for k in range(3)])
    worst = [max((s[i] + s[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i) for i in range(3)]
    assert typology.davies_bouldin(p, "c", "u").first().davies_bouldin == pytest.approx(np.mean(worst))
    d = np.linalg.norm(x[:, None] - centres[None], axis=2)
    got = {r.id: r for r in typology.own_and_other(p, "id", "c", "u").collect()}
    assert all(got[i].own == pytest.approx(d[i, y[i]]) and got[i].other == pytest.approx(np.delete(d[i], y[i]).min()) for i in range(60))
    assert {i for i in got if got[i].prototype} == {int(np.flatnonzero(y == k)[d[y == k, k].argmin()]) for k in range(3)}


def test_one_cluster_has_no_index(spark):
    p = points(spark, [[0.0, 1.0], [1.0, 0.0]], [0, 0])
    assert typology.calinski_harabasz(p, "c", "u").first().calinski_harabasz is None


def test_names_go_to_one_cluster_each(spark):
    means = spark.createDataFrame([(0, 9.0, 1.0), (1, 5.0, 2.0), (2, 8.0, 3.0)], "c int, a double, b double")
    got = {r.c: r.name for r in typology.named(means, "c", [("wide", "a", True), ("tight", "b", False), ("rest", "a", True)]).collect()}
    assert got == {0: "wide", 1: "tight", 2: "rest"}


def test_unbalanced_models_go_unless_all_are(spark):
    schema = "k int, method string, silhouette double, min_size int, max_size int"
    rows = [(3, "ward", 0.2, 8, 40), (4, "ward", 0.9, 1, 90), (5, "ward", 0.3, 9, 35)]
    assert [r.k for r in typology.choose(spark.createDataFrame(rows, schema), 5, 0.7, 100).orderBy("rank").collect()] == [5, 3]
    assert [r.k for r in typology.choose(spark.createDataFrame(rows[1:2], schema), 5, 0.7, 100).collect()] == [4]


def test_trajectories_without_values_give_nothing(spark):
    long = spark.createDataFrame([(1, 0, "m", 1.0), (1, 1, "m", 3.0), (2, 0, "m", None)], "e int, window_index int, metric string, z double")
    got = features.trajectory_features(long, "e", 1).collect()
    assert [(r.e, r.delta, r.slope, r.volatility) for r in got] == [(1, 2.0, 2.0, 0.0)]


def test_gini_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([(0, 2.0)] * 4 + [(1, 0.0)] * 3, "g int, x double")
    assert {r.g: r.gini for r in cloud.gini(df, "g", "x").collect()} == {0: pytest.approx(0.0), 1: 0.0}
