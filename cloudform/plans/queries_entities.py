"""Queries over rows of metrics, similarities over windows, joins and reports of entities, added to those of `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cloud, corpus, density, entities, features, maps, models, profiles, projections, records, rows, shapes, temporal, typology
from ..sources import files, sinks
from ..sources.scratch import settle, shared_folder
from .queries import FIRST, LAST, METRICS, REGISTRY, distance_changes, metric_correlations, metric_distribution, query, rounded, sizes, static_pairs, table, vectors, walk, win  # noqa: F401
from .queries_models import features as scaled_features


def raw(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("work_id"), F.col("label").alias("l1"), (FIRST + F.col("vec_id") % 25).cast("int").alias("year"), "embedding")


def metrics(spark, d):
    return rows.group_metrics(raw(spark, d), "l1", "work_id", 5, FIRST, LAST, least=30)


@query
def group_metrics(spark, d):
    return rounded(metrics(spark, d), 5)


@query
def group_status(spark, d):
    keep = ("l1", "n_available", "n_used", "early_min", "early_max", "late_min", "late_max", "status", "error", "warnings", "effective_k", "n_axes", "centroid_norm", "median_distance", "median_knn", "hub_gini", "median_edge", "drift", "path", "directness")
    return rounded(metrics(spark, d).select(*keep), 5)


@query
def run_manifest(spark, d):
    return sinks.manifest(metrics(spark, d), "l1", F.col("status"), run={"k": "5", "years": f"{FIRST}-{LAST}"}, error=F.col("error"))


@query
def metric_dictionary(spark, d):
    return rows.metric_dictionary(spark)


@query
def metric_scaling(spark, d):
    return rounded(temporal.scaling_parameters(temporal.long_scaled(win(spark, d), "l1", METRICS), ["metric"]))


@query
def window_centroid_status(spark, d):
    t = temporal.window_centroid_table(vectors(spark, d), temporal.windows(spark, FIRST, LAST), "l1", 3, FIRST, LAST)
    return t.select("l1", "window_index", "n", "status", F.size("centroid").alias("dim"))


@query
def centroid_projection(spark, d):
    """Window centroids on their two principal axes."""
    c = temporal.window_centroids(vectors(spark, d), "l1", 3, FIRST, LAST).withColumn("id", F.concat_ws("|", "l1", "window_index"))
    s = models.principal_scores(c, "id", "centroid")
    return rounded(s.select(F.split("id", r"\|")[0].cast("int").alias("l1"), F.split("id", r"\|")[1].cast("int").alias("window_index"), F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y")), 5)


def plane(spark, d):
    return vectors(spark, d).select("l1", "work_id", "year", F.col("u")[0].alias("x"), F.col("u")[1].alias("y"))


@query
def entropy_trends(spark, d):
    return rounded(density.entropy_trend(plane(spark, d), ["l1"], "x", "y", -0.5, 0.5, 8), 5)


def scaled_levels(spark, d):
    long = temporal.long_scaled(win(spark, d), "l1", METRICS).select("l1", "window_index", "metric", F.col("rz").alias("scaled"))
    return profiles.level_means(long, {"l1": F.col("l1"), "l2": F.expr("l1 div 3"), "l3": F.expr("l1 div 6")}, "l1", ("window_index",))


@query
def level_window_means(spark, d):
    return rounded(scaled_levels(spark, d), 5)


def window_pairs(spark, d):
    return profiles.similarities(scaled_levels(spark, d), ("level", "window_index"))


@query
def level_similarities(spark, d):
    return rounded(window_pairs(spark, d), 5)


@query
def similarity_changes(spark, d):
    return rounded(profiles.pair_changes(window_pairs(spark, d), "euclid", 4), 4)


@query
def semantic_distance_changes(spark, d):
    c = cloud.unit_centroids(temporal.in_window(vectors(spark, d), FIRST, LAST), ["l2", "window_index"])
    return rounded(profiles.pair_changes(features.centroid_pairs(c, ["window_index"], "l2"), "d", 4, ()), 5)


@query
def closest_farthest(spark, d):
    return rounded(profiles.closest_and_farthest(static_pairs(spark, d), ("level",), "euclid", 3), 5)


@query
def pair_edges(spark, d):
    movement = walk(spark, d).select(F.col("l1").cast("string").alias("entity"), F.col("path").alias("movement"))
    return rounded(profiles.edge_list(distance_changes(spark, d).where("delta is not null"), movement, 5), 4)


@query
def pair_drivers(spark, d):
    movement = walk(spark, d).select(F.col("l1").cast("string").alias("entity"), "path", "drift")
    return rounded(entities.both_sides(static_pairs(spark, d).where("level = 'l1'").select("a", "b"), movement, "entity", ["path", "drift"]), 5)


def works(spark, d):
    """documents as works: events give topics, labels nothing."""
    docs, ev = table(spark, d, "documents"), table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "event_type", "props", F.year("ts").alias("y"))
    return docs.join(ev, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("work_id"), F.col("source").alias("l1"), F.col("lang").alias("l2"), F.substring("source", 1, 1).alias("l3"), F.col("event_type").alias("topic_id"), F.col("event_type").alias("topic"),
        F.col("props").alias("topics_json"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.col("lang").alias("language"), F.col("source").alias("kind"), F.col("y").alias("year"))


@query
def works_quality(spark, d):
    return corpus.quality_counters(works(spark, d), corpus.work_checks(2000, 2023, "en", ["web", "news"]), "work_id")


@query
def index_join(spark, d):
    v, docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), table(spark, d, "documents").select("doc_id", "lang", "source")
    return entities.many_to_one(v, docs, "doc_id")


@query
def parent_names(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    child = n.select(F.col("n_regionkey").alias("k"), "n_nationkey", F.when(~F.col("n_name").endswith("1"), F.col("n_name")).alias("name"))
    return entities.from_parent(child, r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "k", ["name"])


@query
def nation_totals(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return entities.full_plan([c, s], ["nation"])


def yearly(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query
def range_totals(spark, d):
    return corpus.window_sum(yearly(spark, d), ["o_orderstatus"], 1996, 1998, "n", "n_range")


@query
def counts_by_year(spark, d):
    return entities.by_year(yearly(spark, d), ["o_orderstatus"], "n", range(1995, 1999))


@query
def numbered_documents(spark, d):
    return entities.numbered(table(spark, d, "documents"), ["lang", "n_chars"], "doc_id").select("doc_id", "row_id", F.length("text").alias("n"))


@query
def shared_segment_names(spark, d):
    return entities.shared_names(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query
def unfinished_orders(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partial"))
    return entities.not_completed(o).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query
def reduced_numbers(spark, d):
    ev = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "value")
    return rounded(entities.reduced(ev, ["event_id"], ["k", "value"]), 3)


@query
def cluster_nearest(spark, d):
    return rounded(entities.representatives(vectors(spark, d), "work_id", "l1", "u"), 5)


@query
def largest_orders(spark, d):
    return entities.outliers(table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", "o_orderkey", "o_totalprice", 3)


@query
def strongest_correlations(spark, d):
    return entities.strongest_correlations(metric_correlations(spark, d), "spearman", 3)


@query
def distribution_flags(spark, d):
    return entities.distribution_flags(metric_distribution(spark, d).select("metric", "n_unique", "skew").withColumn("missing_share", F.lit(0.0)), skewed=0.3)


@query
def cluster_reports(spark, d):
    v = vectors(spark, d)
    return rounded(entities.cluster_report(v, "work_id", "l1", "year", typology.own_and_other(v, "work_id", "l1", "u")), 5)


@query
def checkpoint_cap(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return sinks.checkpointed(o.where("o_orderstatus = 'F'"), o, "o_orderkey", "o_custkey", ["o_orderdate"], 5).select("o_orderkey", "o_custkey")


@query
def density_kernel(spark, d):
    return rounded(density.kernel_cells(plane(spark, d), ["l1"], "x", "y", -0.5, 0.5, 8))


@query
def density_ceiling(spark, d):
    return rounded(density.mass_ceiling(density.gated_cells(plane(spark, d), ["l1"], "x", "y", -0.5, 0.5, 8, 20), ["l1"]))


@query
def plane_shapes(spark, d):
    return rounded(shapes.shape_row(plane(spark, d), "l1", "work_id", "x", "y", size=16), 4)


@query
def group_maps(spark, d):
    out = projections.projections(vectors(spark, d), "l1", "work_id", "u", ("pca", "mds", "isomap", "tsne"))
    return rounded(out.groupBy("l1", "method").agg(F.first("n").alias("n"), F.first("trustworthiness").alias("trustworthiness"), F.count("x").alias("n_points")), 4)


def near_of_maps(spark, d):
    v = vectors(spark, d)
    return v, settle(cloud.neighbours(v, "l1", "work_id", 15, sizes(spark, d)))


@query
def neighbour_maps(spark, d):
    """All vectors of each l1 in the plane, by the layout of their neighbour graph."""
    return rounded(maps.neighbour_map(*near_of_maps(spark, d), "l1", "work_id"), 3)


@query
def diffusion_maps(spark, d):
    """All vectors of each l1 in the plane, by a random walk on their neighbour graph."""
    return rounded(maps.diffusion_map(*near_of_maps(spark, d), "l1", "work_id"), 3)


def trajectories(spark, d):
    """Four representations of each l1's path through the windows."""
    long = temporal.long_scaled(win(spark, d), "l1", METRICS)
    f = features.trajectory_features(long, "l1", 4)
    out = {"changes": features.feature_vectors(f, "l1", METRICS, ("delta",)), "slopes": features.feature_vectors(f, "l1", METRICS, ("slope",)), "all": features.feature_vectors(f, "l1", METRICS)}
    whole = long.groupBy("l1").agg(F.transform(F.array_sort(F.collect_list(F.struct("metric", "window_index", F.coalesce("z", F.lit(0.0)).alias("z")))), lambda x: x.z).alias("x"))
    return {k: v.toDF("l1", "x") for k, v in out.items()} | {"whole": whole}


@query
def trajectory_grid(spark, d):
    return rounded(models.variant_grid(trajectories(spark, d), "l1", "x", ["ward", "average:correlation", "kmeans", "spectral:knn4"], [3, 4]), 4)


@query
def blended_grid(spark, d):
    p = static_pairs(spark, d).where("level = 'l1'")
    mixed = typology.blended(p.select("level", "a", "b", "euclid"), p.select("level", "a", "b", F.col("corr").alias("euclid")), "euclid", 0.5)
    return rounded(models.distance_grid(mixed, "euclid", ["average", "complete", "spectral"], [2, 3]), 4)


@query
def metric_space_map(spark, d):
    """The entities' scaled metrics in the plane, one map for all."""
    f = scaled_features(spark, d).withColumn("all", F.lit("l1"))
    return rounded(projections.projections(f, "all", "entity", "x", ("pca", "mds", "tsne")).drop("all"), 3)


@query
def entity_names(spark, d):
    return records.names_by_id(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query
def canonical_flags(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").alias("covered"), (F.col("o_totalprice") > 100000).cast("string").alias("large"))
    out = entities.resolved_flags(o, [{"main": "covered_v3", "robust": "large_v3", "strict": "strict_v3"}, {"main": "covered", "robust": "large"}], ("main", "robust"), {"eligible": "main"})
    return out.groupBy("main", "robust", "strict", "eligible").agg(F.count("*").alias("n"))


@query
def first_entities(spark, d):
    return entities.chosen(table(spark, d, "orders"), "o_custkey", first=20).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query
def derived_columns(spark, d):
    o = entities.with_absent(table(spark, d, "orders"), {"year": F.year("o_orderdate"), "o_orderstatus": F.lit("never")})
    return o.groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"))


@query
def strict_prices(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("partial"))
    return entities.strict_metrics(o, "o_orderkey", ["o_totalprice"])


@query
def threshold_statuses(spark, d):
    means = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").cast("double").alias("n"))
    return entities.threshold_list(means, "n", 1000.0)


@query
def nation_master(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return entities.master_table(n, "k", {"customers": c, "suppliers": s})


@query
def eligible_years(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F").alias("main"))
    return entities.in_years(o, "main", 1993, 1995)


@query
def named_clusters(spark, d):
    means = cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)).groupBy(F.expr("cast(l1 div 3 as int)").alias("l2")).agg(F.avg("mean_distance").alias("width"), F.avg("centroid_norm").alias("norm"))
    return typology.named(means, "l2", [("wide", "width", True), ("narrow", "width", False), ("central", "norm", True)]).select("l2", "name")


@query
def replaced_table(spark, d):
    """A table of the catalogue that is written, read back and taken from the catalogue again."""
    name = f"cloudform_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    sinks.replace_table(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), name, path)
    spark.sql(f"DROP TABLE {name}")
    return files.read_table(spark, path)
