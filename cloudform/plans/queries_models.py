"""Queries over models and shapes, added to those of `queries`. All but the last are no SQL: tests hold them against brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cloud, cluster, density, models, partitioned, shapes, trees
from ..sources import arrays, shards
from ..sources.scratch import shared_folder
from .queries import METRICS, REGISTRY, grid, query, rounded, static_pairs, table, vectors  # noqa: F401
from .queries_summaries import scaled_profiles


def features(spark, d):
    """Scaled metrics of each l1 as a vector in the order of METRICS; missing ones are 0."""
    long = scaled_profiles(spark, d).where("level = 'l1'")
    return long.groupBy("entity").agg(F.array(*(F.coalesce(F.max(F.when(F.col("metric") == m, F.col("scaled"))), F.lit(0.0)) for m in METRICS)).alias("x"))


def centres(spark, d):
    return cloud.unit_centroids(vectors(spark, d), ["l1"]).select(F.col("l1").cast("string").alias("entity"), F.col("centroid").alias("x"))


@query
def cluster_grid(spark, d):
    return rounded(models.model_grid(features(spark, d), "entity", "x", ["ward", "average", "average:correlation", "complete", "kmeans", "mixture", "spectral"], [3, 4, 5]), 5)


@query
def centroid_grid(spark, d):
    return rounded(models.model_grid(centres(spark, d), "entity", "x", ["average:cosine", "ward", "spectral:cosine"], [2, 3, 4]), 5)


@query
def cluster_stability(spark, d):
    return rounded(models.stability(features(spark, d), "entity", "x", "ward", 3))


@query
def mixture_members(spark, d):
    return rounded(partitioned.mixture_clusters(features(spark, d), "entity", "x", 2), 4)


@query
def vector_clusters(spark, d):
    """All vectors in ten clusters, over partitions."""
    return rounded(partitioned.kmeans_clusters(vectors(spark, d), "work_id", "u", 10, restarts=2), 4)


@query
def vector_mixture(spark, d):
    """All vectors under a mixture in the space of their five first principal components."""
    p = models.principal_scores(vectors(spark, d), "work_id", "u", n=5).select("work_id", F.col("scores").alias("x"))
    return rounded(partitioned.mixture_clusters(p, "work_id", "x", 4), 3)


def written_shards(spark, d):
    """The folder of the table's vectors in shards of about 4096, and the table of their metadata."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", "embedding")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    arrays.write_shards(arrays.planned_shards(e, "vec_id", 4096), folder, "vec_id", "embedding").write.format("noop").mode("overwrite").save()
    schema = e.drop("embedding").withColumn("shard", F.lit(0)).withColumn("row", F.lit(0)).select("vec_id", "label", "row").schema
    return folder, shards.metadata_index(spark, folder, schema)


@query
def shard_vectors(spark, d):
    """Every vector written to shards and read again by ranges of bytes, beside its metadata."""
    folder, index = written_shards(spark, d)
    v = arrays.read_arrays(spark, folder, size=1 << 18)
    u = F.col("embedding").cast("array<double>")
    return rounded(index.join(v, ["shard", "row"]).select("vec_id", "label", F.size(u).alias("dim"), F.get(u, F.lit(0)).alias("first"), F.element_at(u, -1).alias("last")), 5)


@query
def shard_counts(spark, d):
    """Rows of the arrays' headers and of the metadata, and how many checks of the shards fail."""
    folder, index = written_shards(spark, d)
    shapes_ = arrays.array_headers(spark, folder)
    dim = shapes_.agg(F.max("dim").alias("dim"), F.sum("n_rows").alias("n_rows"))
    bad = shards.shard_errors(shards.shard_files(spark, folder), shapes_, index, expected=None, dim=dim.first().dim, dtype="float32")
    return dim.crossJoin(index.agg(F.count("*").alias("n_meta"), F.count_distinct("vec_id").alias("n_ids"))).crossJoin(bad.agg(F.count("*").alias("n_errors")))


@query
def density_clusters(spark, d):
    """Clusters of at least five vectors within each l1, by density."""
    return trees.density_clusters(vectors(spark, d), "l1", "work_id", "u")


@query
def principal_scores(spark, d):
    s = models.principal_scores(vectors(spark, d), "work_id", "u")
    return rounded(s.select("work_id", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"), F.col("shares")[0].alias("share1"), F.col("shares")[1].alias("share2")), 5)


@query
def hybrid_grid(spark, d):
    p = models.principal_scores(centres(spark, d), "entity", "x", n=None, share=0.8).select("entity", F.col("scores").alias("x"))
    return rounded(models.model_grid(models.joined_blocks([p, features(spark, d)], "entity", "x"), "entity", "x", ["ward", "average"], [3, 4]), 5)


@query
def scaled_positions(spark, d):
    out = models.classical_scaling(static_pairs(spark, d).where("level <> 'l3'"), "level", "euclid")
    return rounded(out.select("level", "entity", F.col("point")[0].alias("x"), F.col("point")[1].alias("y")), 5)


@query
def density_shape(spark, d):
    return rounded(shapes.density_shape(density.smoothed(grid(spark, d), ["l1"], 8, 1.0), "l1", 8))


@query
def spanning_gaps(spark, d):
    p = vectors(spark, d).select("l1", "work_id", F.col("u")[0].alias("x"), F.col("u")[1].alias("y"))
    return rounded(shapes.spanning_gaps(p, "l1", "x", "y"), 5)


@query
def partition_verdicts(spark, d):
    v = vectors(spark, d).withColumn("part", F.col("year") % 4)
    a, b = cluster.adjusted_rand(v, "l1", "l2"), cluster.adjusted_rand(v, "l1", "part")
    both = a.select(F.lit("l1_l2").alias("pair"), "ari").union(b.select(F.lit("l1_part"), "ari"))
    return rounded(both.withColumn("verdict", models.verdict("ari")))
