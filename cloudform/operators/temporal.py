"""Windows of years, evolution of metrics over them, and the paths of centroids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.num import correlation, mean_rank, ratio, robust, trend
from ..functions.vec import centroids, cosine_distance, euclid, unit
from .cloud import dispersion


def windows(spark: SparkSession, first: int, last: int, size: int = 5) -> DataFrame:
    """A row for each run of `size` years; the last one may be shorter."""
    rows = [(i, a, min(a + size - 1, last), f"{a}-{min(a + size - 1, last)}", (a + min(a + size - 1, last)) / 2) for i, a in enumerate(range(first, last + 1, size))]
    return spark.createDataFrame(rows, "window_index int, window_start int, window_end int, window_label string, mid_year double")


def in_window(rows: DataFrame, first: int, last: int, size: int = 5) -> DataFrame:
    return rows.where(F.col("year").between(first, last)).withColumn("window_index", F.floor((F.col("year") - first) / size).cast("int"))


def window_metrics(rows: DataFrame, wins: DataFrame, entity: str, least: int, first: int, last: int, size: int = 5, sizes: DataFrame | None = None) -> DataFrame:
    """Dispersion of each entity in each window, a row for every pair; too few rows: skipped. sizes(n) bounds all groups' sizes."""
    some = in_window(rows, first, last, size)
    m = dispersion(some, [entity, "window_index"], sizes)
    grid = rows.select(entity).distinct().crossJoin(F.broadcast(wins))  # entities times a few windows
    out = grid.join(m, [entity, "window_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    values = [c for c in m.columns if c not in (entity, "window_index", "n")]
    return out.select(entity, *wins.columns, "n", F.when(enough, "completed").otherwise("skipped").alias("status"), *(F.when(enough, F.col(c)).alias(c) for c in values))


def long_scaled(wm: DataFrame, entity: str, metrics: list[str]) -> DataFrame:
    """A row for each entity, window and metric, with z and robust z over all rows of the metric."""
    long = wm.unpivot([entity, "window_index", "mid_year"], metrics, "metric", "value")
    q = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    par = long.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), q.alias("q"))
    return long.join(F.broadcast(par), "metric").select(entity, "window_index", "mid_year", "metric", "value", ratio(F.col("value") - F.col("m"), F.col("s")).alias("z"), robust(F.col("value"), F.col("q")).alias("rz"))  # a row for each metric


def scaling_parameters(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, deviation, median, quartiles and their range of the values by keys."""
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    out = long.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q"))
    return out.select(*keys, "n", "mean", "std", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def changes(long: DataFrame, entity: str, n_windows: int) -> DataFrame:
    """First to last change, trends and rank correlation with time of each entity and metric."""
    known = long.where("value is not null")
    ranked = known.withColumns({"rv": mean_rank("value", entity, "metric"), "rt": F.rank().over(Window.partitionBy(entity, "metric").orderBy("window_index"))})
    at = lambda w, c: F.max(F.when(F.col("window_index") == w, F.col(c)))
    out = ranked.groupBy(entity, "metric").agg(
        F.count("*").alias("n_windows"), at(0, "value").alias("first_value"), at(n_windows - 1, "value").alias("last_value"), (at(n_windows - 1, "z") - at(0, "z")).alias("delta_z"), (at(n_windows - 1, "rz") - at(0, "rz")).alias("delta_rz"),
        F.when(F.count("*") > 1, F.regr_slope("value", "mid_year")).alias("slope"), F.when(F.count("*") > 1, F.regr_slope("z", "mid_year")).alias("slope_z"), correlation(F.col("rv"), F.col("rt").cast("double")).alias("spearman"))
    return out.select("*", (F.col("last_value") - F.col("first_value")).alias("delta"), trend(F.col("delta_z")).alias("trend"))


def change_ranking(ch: DataFrame, entity: str) -> DataFrame:
    """Entities by the length of their vector of changes over the metrics, with that of their slopes."""
    length = lambda c: F.coalesce(F.sqrt(F.sum(F.col(c) * F.col(c))), F.lit(0.0))
    out = ch.groupBy(entity).agg(length("delta_z").alias("change"), length("slope_z").alias("slope_norm"), F.count("delta_z").alias("n_metrics"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("change").desc(), entity)))  # a row for each entity


def window_centroids(rows: DataFrame, entity: str, least: int, first: int, last: int, size: int = 5) -> DataFrame:
    some = in_window(rows, first, last, size)
    n = some.groupBy(entity, "window_index").count().where(F.col("count") >= least)
    return centroids(some, [entity, "window_index"], "u").join(n, [entity, "window_index"]).withColumn("centroid", unit("centroid"))


def window_centroid_table(rows: DataFrame, wins: DataFrame, entity: str, least: int, first: int, last: int, size: int = 5) -> DataFrame:
    """The unit centroid of each entity in each window, a row for every pair; too few rows: skipped, without a vector."""
    some = in_window(rows, first, last, size)
    n = some.groupBy(entity, "window_index").agg(F.count("*").alias("n"))
    grid = rows.select(entity).distinct().crossJoin(F.broadcast(wins))  # entities times a few windows
    out = grid.join(n, [entity, "window_index"], "left").join(window_centroids(rows, entity, least, first, last, size).select(entity, "window_index", "centroid"), [entity, "window_index"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", F.when(F.col("n") >= least, "completed").otherwise("skipped"))


def paths(cen: DataFrame, entity: str) -> DataFrame:
    """Steps between completed windows (gaps are bridged): path, drift, their ratio, and the largest step."""
    w = Window.partitionBy(entity).orderBy("window_index")
    step = cen.withColumn("before", F.lag("centroid").over(w)).select(entity, "window_index", "centroid", cosine_distance("centroid", "before").alias("step"), euclid("centroid", "before").alias("leg"))
    ends = lambda f: f("centroid", "window_index")
    out = step.groupBy(entity).agg(F.count("*").alias("n_windows"), F.sum("step").alias("path"), F.sum("leg").alias("length"), F.max_by("window_index", F.struct("step", -F.col("window_index"))).alias("largest_step_window"), F.max("step").alias("largest_step"), ends(F.min_by).alias("a"), ends(F.max_by).alias("b"))
    drifted = out.withColumns({"drift": F.when(F.col("n_windows") > 1, cosine_distance("a", "b")), "straight": F.when(F.col("n_windows") > 1, euclid("a", "b"))})
    return drifted.select(entity, "n_windows", "path", "drift", ratio(F.col("straight"), F.col("length")).alias("directness"), F.when(F.col("largest_step").isNotNull(), F.col("largest_step_window")).alias("largest_step_window"), "largest_step")


def by_level(table: DataFrame, level: Column, values: list[str]) -> DataFrame:
    return table.groupBy(level.alias("level")).agg(F.count("*").alias("n_entities"), *reduce(lambda a, v: [*a, F.avg(v).alias(f"mean_{v}"), F.median(v).alias(f"median_{v}")], values, []))
