"""Queries over summaries and comparisons, added to those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cloud, corpus, profiles, summaries, temporal
from .queries import METRICS, REGISTRY, change, counts, near, order_years, query, raw_profiles, rounded, sizes, table, vectors, win  # noqa: F401
from .queries_typology import plane


@query
def converging_pairs(spark, d):
    long = temporal.long_scaled(win(spark, d), "l1", METRICS).select("window_index", "metric", F.col("l1").cast("string").alias("entity"), F.col("rz").alias("scaled"))
    return rounded(summaries.directional(profiles.distance_changes(long, 4).select("a", "b", "delta"), "delta", ["a", "b"], 3), 5)


@query
def entity_retention(spark, d):
    return summaries.retention(temporal.long_scaled(win(spark, d), "l1", METRICS), "l1", 4)


def cells_covered(spark, d):
    plan = corpus.sample_plan(counts(spark, d), "n_all", 5, 1.75)
    return corpus.coverage(plan, order_years(spark, d).where("o_orderstatus = 'F'"), ["c_nationkey", "c_mktsegment", "year"])


@query
def entity_coverage(spark, d):
    return rounded(summaries.coverage_totals(cells_covered(spark, d), ["c_nationkey", "c_mktsegment"]))


@query
def year_coverage(spark, d):
    return rounded(summaries.coverage_totals(cells_covered(spark, d), ["year"]))


@query
def change_signs(spark, d):
    return rounded(summaries.sign_counts(change(spark, d), ["metric"], "delta_z"), 5)


def longs(spark, d):
    return cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)).unpivot(["l1"], METRICS, "metric", "value")


def holed(spark, d):
    gone = ((F.col("metric") == "iqr_distance") & (F.col("l1") % 5 == 1)) | ((F.col("metric") == "p90_distance") & (F.col("l1") % 2 == 1))
    return longs(spark, d).withColumn("value", F.when(~gone, F.col("value")))


@query
def cluster_profile_z(spark, d):
    return rounded(summaries.against_all(longs(spark, d).withColumn("cluster", F.expr("cast(l1 div 3 as int)")), "cluster"), 5)


@query
def metric_information(spark, d):
    return rounded(summaries.information(holed(spark, d)))


@query
def family_correlations(spark, d):
    return rounded(summaries.cross_correlations(longs(spark, d), "l1", METRICS[:2], METRICS[2:]), 5)


@query
def imputed_metrics(spark, d):
    return rounded(summaries.imputed(holed(spark, d), "l1"), 5)


def scaled_profiles(spark, d):
    return profiles.scaled(raw_profiles(spark, d), METRICS)


@query
def balanced_scaling(spark, d):
    f = {"mean_distance": "centre", "median_distance": "centre", "p90_distance": "centre", "iqr_distance": "spread"}
    return rounded(summaries.family_balanced(scaled_profiles(spark, d), f).select("level", "entity", "metric", "scaled"), 5)


def two_specs(spark, d):
    s = scaled_profiles(spark, d)
    a, b = profiles.distances(s), profiles.distances(s.where(F.col("metric").isin(METRICS[1:])))
    return summaries.compared(a, b, ["level", "a", "b"], "level", "euclid")


@query
def spec_pairs(spark, d):
    return rounded(two_specs(spark, d), 5)


@query
def spec_agreement(spark, d):
    return rounded(summaries.agreement(two_specs(spark, d), "level"), 5)


@query
def domain_ends(spark, d):
    return summaries.ends(scaled_profiles(spark, d).where("level <> 'l3'"), ["level", "metric"], "entity", "scaled")


@query
def kth_neighbour_stats(spark, d):
    return rounded(summaries.kth_neighbour(near(spark, d)[1], "l1", 5))


@query
def plane_yearly_path(spark, d):
    return rounded(summaries.yearly_path(plane(spark, d), ["l1"], "x", "y"), 5)


@query
def matrix_checks(spark, d):
    return summaries.matrix_checks(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query
def share_pivot(spark, d):
    return rounded(summaries.share_pivot(vectors(spark, d).withColumn("part", F.col("year") % 4), "l1", "part", [0, 1, 2, 3]))


@query
def top_ranked_profiles(spark, d):
    t = cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)).select("l1", *METRICS)
    return rounded(summaries.ranked_first(t, t, "l1", [F.col("p90_distance").desc()], 4))
