import pytest
from pyspark.sql import functions as F

from cloudform.operators import summaries as S


def test_directional_ranks_each_side_and_skips_no_change(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", -3.0), ("c", 0.0), ("d", None), ("e", 2.0), ("f", 2.0)], "id string, x double")
    got = {(r.side, r["rank"]): r.id for r in S.directional(df, "x", ["id"], 2).collect()}
    assert got == {("converging", 1): "b", ("converging", 2): "a", ("diverging", 1): "e", ("diverging", 2): "f"}


def test_retention_gives_reasons(spark):
    rows = [(e, w, m, v) for e, n in ((1, (2, 2)), (2, (1, 2)), (3, (2, 0)), (4, (0, 0))) for w, k in zip((0, 4), n, strict=True) for m, v in (("p", 1.0 if k > 0 else None), ("q", 1.0 if k > 1 else None))]
    got = S.retention(spark.createDataFrame(rows, "e int, window_index int, metric string, value double"), "e", 4).collect()
    assert {r.e: r.reason for r in got} == {1: "kept", 2: "first_window", 3: "last_window", 4: "both_windows"}


def test_information_and_imputation(spark):
    rows = [(i, "full", float(i)) for i in range(10)] + [(i, "gone", None if i < 5 else float(i)) for i in range(10)] + [(i, "flat", 1.0) for i in range(10)] + [(i, "few", None if i == 0 else float(i % 4)) for i in range(10)]
    long = spark.createDataFrame(rows, "id int, metric string, value double")
    assert {r.metric: r.flag for r in S.information(long).collect()} == {"full": "fine", "gone": "missing", "flat": "constant", "few": "fine"}
    got = S.imputed(long, "id").collect()
    assert {r.metric for r in got} == {"full", "few"} and not [r for r in got if r.value is None]
    assert sum(r.z for r in got if r.metric == "full") == pytest.approx(0)


def test_comparisons_and_constant_sides(spark):
    a = spark.createDataFrame([("g", i, float(i)) for i in range(4)], "level string, k int, v double")
    c = S.compared(a, a.withColumn("v", -F.col("v")), ["level", "k"], "level", "v")
    assert S.agreement(c, "level").first().spearman == pytest.approx(-1)
    assert S.agreement(c.withColumn("y", F.lit(1.0)), "level").first().pearson is None
    assert {r.k: r.best_rank for r in c.collect()} == {0: 1, 1: 2, 2: 2, 3: 1}


def test_path_of_yearly_medians(spark):
    p = spark.createDataFrame([("a", 2000, 0.0, 0.0), ("a", 2001, 3.0, 4.0), ("a", 2002, 0.0, 0.0), ("b", 2000, 1.0, 1.0)], "g string, year int, x double, y double")
    got = {r.g: r for r in S.yearly_path(p, ["g"], "x", "y").collect()}
    assert (got["a"].drift, got["a"].path, got["a"].step_cv) == (0.0, 10.0, 0.0) and got["b"].path is None


def test_checks_of_empty_and_broken_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0]), (3, None)], "id long, v array<double>")
    r = S.matrix_checks(df, "id", "v", 2).first()
    assert (r.n, r.wrong_dimension, r.repeated, r.contiguous) == (3, 2, 1, False)
    assert S.matrix_checks(df.limit(0), "id", "v", 2).first().contiguous
