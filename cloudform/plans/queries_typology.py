"""Queries over records, typologies and trajectories, added to those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cloud, corpus, features, profiles, records, temporal, typology
from .queries import FIRST, LAST, METRICS, REGISTRY, change, counts, grid, order_years, query, raw_profiles, rounded, sizes, static_pairs, table, vectors, walk, win  # noqa: F401


@query
def url_short_ids(spark, d):
    return table(spark, d, "pages").select("page_id", records.short_id("url").alias("short_id"), records.slug(F.col("page_id"), F.col("url")).alias("slug"))


@query
def record_acceptance(spark, d):
    docs = table(spark, d, "documents")
    why = records.acceptance({"id": F.col("doc_id").isNotNull(), "language": F.col("lang") == "en", "source": F.trim("source") != "", "length": corpus.token_count("text") >= 80})
    return docs.groupBy(why.alias("rejected")).agg(F.count("*").alias("n"))


@query
def error_classes(spark, d):
    text = F.concat_ws(" ", F.when(F.col("value") > 100, "HTTP 429").when(F.col("value") > 80, "read timed out").when(F.col("value") > 60, "status 503").when(F.col("value") > 40, "connection reset").when(F.col("value") > 20, "odd"))
    return table(spark, d, "events").groupBy(records.error_class(text).alias("error")).agg(F.count("*").alias("n"))


def sampled(spark, d):
    return corpus.sample_plan(counts(spark, d), "n_all", 5, 1.75)


@query
def request_totals(spark, d):
    return records.request_totals(sampled(spark, d), "method", "first_request", 3)


@query
def backfill_requests(spark, d):
    short = corpus.coverage(sampled(spark, d), order_years(spark, d).where("o_orderstatus = 'F'"), ["c_nationkey", "c_mktsegment", "year"])
    return records.backfill(short, ["c_nationkey", "c_mktsegment", "year"], 1.75, 1, 7).drop("seed")


@query
def completion_report(spark, d):
    plan = sampled(spark, d).where("planned > 0")
    return rounded(records.completion(plan, order_years(spark, d).where("o_orderstatus = 'F'"), ["c_nationkey", "c_mktsegment", "year"]))


@query
def attribute_mismatches(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.lower("lang").alias("lang"))
    b = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "lang")
    return records.mismatches(a, b, "doc_id", ["n_chars", "lang"])


@query
def key_overlap(spark, d):
    o = table(spark, d, "orders")
    return rounded(records.overlap(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 100000"), "o_custkey"))


@query
def merged_records(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    part = records.union_new(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.drop("o_orderstatus").withColumn("o_totalprice", F.lit(-1.0)), "o_orderkey", ["o_custkey"])
    return part.groupBy((F.col("o_totalprice") == -1).alias("new")).agg(F.count("*").alias("n"))


@query
def cluster_margins(spark, d):
    return rounded(typology.own_and_other(vectors(spark, d), "work_id", "l1", "u"))


@query
def cluster_quality_indices(spark, d):
    v = vectors(spark, d)
    return rounded(typology.calinski_harabasz(v, "l1", "u").crossJoin(typology.davies_bouldin(v, "l1", "u")), 5)  # one row each


@query
def contingency_nmi(spark, d):
    return rounded(typology.normalised_mutual_information(vectors(spark, d).withColumn("part", F.col("year") % 4), "l1", "part"))


@query
def cluster_dominant(spark, d):
    return rounded(typology.dominant(vectors(spark, d).withColumn("part", F.col("year") % 4), "l1", "part"))


@query
def cluster_shares(spark, d):
    return rounded(typology.shares_both_ways(vectors(spark, d).withColumn("part", F.col("year") % 4), "l1", "part"))


@query
def cluster_traits(spark, d):
    long = profiles.scaled(raw_profiles(spark, d), METRICS).where("level = 'l1'").withColumn("cluster", F.expr("cast(entity as int) div 3"))
    return rounded(typology.traits(long, "cluster", 2), 5)


@query
def typology_names(spark, d):
    rules = [("spread", "p90_distance", True), ("compact", "median_distance", False), ("mixed", "iqr_distance", True)]
    return rounded(typology.named(cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)).select("l1", *METRICS), "l1", rules))


@query
def blended_distances(spark, d):
    p = static_pairs(spark, d)
    return rounded(typology.blended(p.select("level", "a", "b", F.col("euclid").alias("d")), p.select("level", "a", "b", F.col("corr").alias("d")), "d", 0.7), 5)


@query
def domain_gap_medians(spark, d):
    p = static_pairs(spark, d).where("level = 'l1'")
    dom = vectors(spark, d).select(F.col("l1").cast("string").alias("entity"), "l2").distinct()
    return rounded(typology.domain_gaps(p, dom, "euclid"), 5)


@query
def pair_movement(spark, d):
    m = walk(spark, d).select(F.col("l1"), "path")
    j = static_pairs(spark, d).where("level = 'l1'").select("a", "b").join(m.select(F.col("l1").cast("string").alias("a"), F.col("path").alias("pa")), "a").join(m.select(F.col("l1").cast("string").alias("b"), F.col("path").alias("pb")), "b")
    return j.groupBy(typology.moved("pa", "pb", 1.2).alias("moved")).agg(F.count("*").alias("n"))


def lz(spark, d):
    return temporal.long_scaled(win(spark, d), "l1", METRICS)


@query
def complete_windows(spark, d):
    return features.complete_entities(win(spark, d), "l1", 5).select("l1", "window_index", "n")


@query
def trajectory_features(spark, d):
    return rounded(features.trajectory_features(lz(spark, d), "l1", 4), 5)


@query
def trajectory_vectors(spark, d):
    f = features.feature_vectors(features.trajectory_features(lz(spark, d), "l1", 4), "l1", METRICS)
    return rounded(f.select("l1", F.posexplode("features").alias("i", "x")), 5)


@query
def change_texts(spark, d):
    return features.change_text(change(spark, d), "l1")


def upper(spark, d):
    some = temporal.in_window(vectors(spark, d), FIRST, LAST)
    n = some.groupBy("l1", "l2", "window_index").agg(F.count("*").alias("n"))
    c = cloud.unit_centroids(some, ["l1", "l2", "window_index"]).join(n, ["l1", "l2", "window_index"])
    return features.weighted_centroids(c, ["l2", "window_index"], "n")


@query
def centroid_pair_distances(spark, d):
    return rounded(features.centroid_pairs(upper(spark, d), ["window_index"], "l2"))


def plane(spark, d):
    return vectors(spark, d).select("l1", "year", F.col("u")[0].alias("x"), F.col("u")[1].alias("y"))


@query
def plane_extents(spark, d):
    return rounded(features.padded_extent(plane(spark, d), ["l1"], "x", "y"))


@query
def plane_shape(spark, d):
    return rounded(features.radial_shape(plane(spark, d), ["l1"], "x", "y"), 5)


@query
def plane_window_means(spark, d):
    return rounded(features.window_means(temporal.in_window(plane(spark, d), FIRST, LAST), temporal.windows(spark, FIRST, LAST), "x", "y"))


@query
def cell_gini(spark, d):
    return rounded(cloud.gini(grid(spark, d).withColumn("n", F.col("n").cast("double")), "l1", "n"))
