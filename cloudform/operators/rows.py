"""One row of metrics for each group of vectors, with a status and warnings in place of errors, also by windows of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..sources.scratch import settle
from . import cloud
from .quantiles import group_percentiles
from .temporal import in_window

# Name, family and meaning of each metric, in the order of the output.
DICTIONARY = (
    ("centroid_norm", "concentration", "norm of the mean unit vector"),
    ("mean_distance", "concentration", "mean cosine distance to the centroid"),
    ("median_distance", "concentration", "median cosine distance to the centroid"),
    ("std_distance", "concentration", "deviation of the distances to the centroid"),
    ("iqr_distance", "concentration", "interquartile range of the distances to the centroid"),
    ("p90_distance", "concentration", "ninth decile of the distances to the centroid"),
    ("p90_to_median", "concentration", "ninth decile over the median of the distances"),
    ("mean_knn", "neighbours", "mean distance to the k nearest others"),
    ("median_knn", "neighbours", "median distance to the k nearest others"),
    ("p90_knn", "neighbours", "ninth decile of the distances to the k nearest others"),
    ("cv_knn", "neighbours", "deviation over the mean of these distances"),
    ("hub_gini", "neighbours", "inequality of how often each vector is a neighbour"),
    ("top1", "spectrum", "share of variance of the first component"),
    ("top3", "spectrum", "share of variance of the first three components"),
    ("top5", "spectrum", "share of variance of the first five components"),
    ("d50", "spectrum", "components that reach half of the variance"),
    ("d80", "spectrum", "components that reach four fifths of the variance"),
    ("participation", "spectrum", "participation ratio of the variances"),
    ("entropy", "spectrum", "entropy of the shares of variance over its maximum"),
    ("n_components", "graph", "connected components of the neighbour graph"),
    ("largest_share", "graph", "share of the largest component"),
    ("median_edge", "graph", "median length of the graph's edges"),
    ("p90_edge", "graph", "ninth decile of the lengths of the graph's edges"),
    ("drift", "time", "distance of the centroids of the first and the last years"),
    ("path", "time", "sum of the distances of the centroids of consecutive years"),
    ("directness", "time", "drift over path"),
)
METRICS = tuple(name for name, *_ in DICTIONARY)
WINDOW_METRICS = ("median_distance", "iqr_distance", "p90_distance", "median_knn", "cv_knn", "hub_gini", "d80", "entropy")


def metric_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(DICTIONARY)], "place int, metric string, family string, meaning string")


def year_window(first: int, last: int, *, supported: tuple[int, int] = (2000, 2024), edge: int = 5) -> dict[str, int]:
    """The range of years and its early and late edges, which are cut to the range; an error outside the supported years."""
    if first > last:
        raise ValueError(f"the first year {first} is after the last {last}")
    if first < supported[0] or last > supported[1]:
        raise ValueError(f"{first}-{last} is not within {supported[0]}-{supported[1]}")
    return {"year_min": first, "year_max": last, "early_min": first, "early_max": min(first + edge - 1, last), "late_min": max(last - edge + 1, first), "late_max": last}


def families(rows: DataFrame, group: str, id_: str, k: int, counts: DataFrame, *, graph: bool = True, spectral: bool = True) -> list[DataFrame]:
    """Tables of the metrics that need no years, each with a row for each group of unit rows; counts(group, n) bounds their sizes."""
    near = settle(cloud.neighbours(rows, group, id_, k, counts))
    pairs = counts.select(group, (F.col("n") * k).alias("n"))
    out = [cloud.dispersion(rows, [group], counts).drop("n"), cloud.neighbour_stats(near, group, pairs).drop("n_pairs"), cloud.hub_gini(rows, near, group, id_)]
    if spectral:
        out.append(cloud.spectrum(rows, group, counts).drop("n"))
    if graph:
        edges = settle(cloud.graph_edges(near, group))
        q = group_percentiles(edges, [group], "d", [0.5, 0.9], sizes=pairs)
        out += [cloud.graph_components(rows, edges, group, id_), q.select(group, F.col("q")[0].alias("median_edge"), F.col("q")[1].alias("p90_edge"))]
    return out


def group_metrics(vectors: DataFrame, group: str, id_: str, k: int, first: int, last: int, *, least: int = 1, vector: str = "embedding", edge: int = 5, least_year: int = 3) -> DataFrame:
    """A row for each group of vectors(group, id, year, vector): counts, status, error, warnings and all metrics.

    Groups with fewer rows than `least` are skipped, groups without a usable vector have failed; both keep their row with
    NULL metrics. What a group lacks for some metric is a warning.
    """
    w = year_window(first, last, edge=edge)
    counts = vectors.groupBy(group).agg(F.count("*").alias("n_available"))
    some = vectors.join(counts.where(F.col("n_available") >= least).select(group), group, "left_semi")
    rows = settle(cloud.unit_rows(some.select(group, id_, "year", vector), vector))
    out = counts.join(rows.groupBy(group).agg(F.count("*").alias("n_used"), F.max(F.size("u")).alias("dim")), group, "left").na.fill(0, ["n_used"])
    inside = rows.where(F.col("year").between(first, last))
    time = cloud.drift(inside, group, first, last, edge, least_year).join(cloud.annual_path(inside, group, least_year), group, "left").withColumn("directness", ratio(F.col("drift"), F.col("path")))
    for t in (*families(rows, group, id_, k, counts.select(group, F.col("n_available").alias("n"))), time):
        out = out.join(t, group, "left")
    skipped, failed = F.col("n_available") < least, F.col("n_used") == 0
    lacks = F.when(F.lit(True), F.array(
        F.when(F.col("n_used") < F.col("n_available"), "vectors without a direction were left out"), F.when(F.col("n_used") <= k, "fewer neighbours than asked for"),
        F.when(F.col("n_used") < 2, "no neighbours and no spectrum of a single vector"), F.when(F.col("drift").isNull(), "too few rows in the first or last years"),
        F.when(F.col("path").isNull(), "fewer than two years with enough rows")))
    warnings = F.when(skipped | failed, F.array().cast("array<string>")).otherwise(F.filter(lacks, lambda x: x.isNotNull()))
    status = F.when(skipped, "skipped").when(failed, "failed").when(F.size("warnings") > 0, "completed_with_warnings").otherwise("completed")
    error = F.when(skipped, f"fewer than {least} rows").when(failed, "no usable vector").otherwise("")
    return out.withColumn("warnings", warnings).select(
        group, "n_available", "n_used", *(F.lit(v).alias(c) for c, v in w.items()), status.alias("status"), error.alias("error"), F.array_join("warnings", "; ").alias("warnings"),
        F.lit(k).alias("k"), F.greatest(F.least(F.lit(k), F.col("n_used") - 1), F.lit(0)).cast("int").alias("effective_k"), F.greatest(F.least(F.col("dim"), F.col("n_used") - 1), F.lit(0)).cast("int").alias("n_axes"),
        *(F.col(m).cast("double").alias(m) for m in METRICS))


def window_group_metrics(rows: DataFrame, wins: DataFrame, entity: str, id_: str, k: int, least: int, first: int, last: int, size: int = 5, metrics: tuple[str, ...] = WINDOW_METRICS) -> DataFrame:
    """The window metrics of each entity in each window, a row for every pair; too few rows: skipped. Others than `metrics` are left out."""
    cell, kind = "_cell", rows.schema[entity].dataType
    inside = in_window(rows, first, last, size).select(entity, id_, "u", "window_index", F.concat_ws("|", "window_index", entity).alias(cell))
    inside = settle(inside)
    n = inside.groupBy(cell).agg(F.count("*").alias("n"))
    some = inside.join(n.where(F.col("n") >= least).select(cell), cell, "left_semi")
    out = n
    n = settle(n)
    for t in families(some, cell, id_, k, n, graph=False, spectral=any(f == "spectrum" for m, f, _ in DICTIONARY if m in metrics)):
        out = out.join(t, cell, "left")
    split = F.split(cell, r"\|", 2)
    out = out.select(split[1].cast(kind).alias(entity), split[0].cast("int").alias("window_index"), "n", *metrics)
    grid = rows.select(entity).distinct().crossJoin(F.broadcast(wins))  # entities times a few windows
    full = grid.join(out, [entity, "window_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(entity, *wins.columns, "n", F.when(F.col("n") >= least, "completed").otherwise("skipped").alias("status"), *metrics)
