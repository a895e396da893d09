"""Features of trajectories, texts of changes, centroids of higher levels, and the geometry of points in the plane."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..functions.vec import cosine_distance


def complete_entities(wm: DataFrame, entity: str, n_windows: int) -> DataFrame:
    """Rows of the entities that completed every window."""
    whole = wm.where("status = 'completed'").groupBy(entity).agg(F.count_distinct("window_index").alias("n")).where(F.col("n") == n_windows)
    return wm.join(whole, entity, "left_semi")


def trajectory_features(long: DataFrame, entity: str, last: int) -> DataFrame:
    """Per entity and metric: change, slope over windows and volatility (deviation of the steps) of the scaled values."""
    w = Window.partitionBy(entity, "metric").orderBy("window_index")
    step = long.where("z is not null").withColumn("step", F.col("z") - F.lag("z").over(w))
    at = lambda i: F.max(F.when(F.col("window_index") == i, F.col("z")))
    return step.groupBy(entity, "metric").agg((at(last) - at(0)).alias("delta"), F.when(F.count("*") > 1, F.regr_slope("z", "window_index")).alias("slope"), F.stddev_pop("step").alias("volatility"))


def feature_vectors(features: DataFrame, entity: str, metrics: list[str], parts: tuple[str, ...] = ("delta", "slope", "volatility")) -> DataFrame:
    """One array for each entity, in the order of metrics and parts, standardised over entities; missing is 0."""
    long = features.where(F.col("metric").isin(metrics)).unpivot([entity, "metric"], list(parts), "part", "x")
    par = long.groupBy("metric", "part").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.join(F.broadcast(par), ["metric", "part"]).withColumn("z", F.coalesce(ratio(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)))  # a row for each metric and part
    at = F.array_position(F.array(*(F.lit(f"{m}:{p}") for m in metrics for p in parts)), F.concat_ws(":", "metric", "part"))
    listed = z.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col("z")))).alias("c"))
    return listed.select(entity, F.transform("c", lambda c: c.z).alias("features"))


def change_text(changes: DataFrame, entity: str, value: str = "delta_z", n: int = 3) -> DataFrame:
    """The n most changed metrics of each entity as `metric:+0.12; ...`."""
    w = Window.partitionBy(entity).orderBy(F.abs(value).desc(), "metric")
    top = changes.where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    item = F.concat("metric", F.lit(":"), F.format_string("%+.2f", value))
    return top.groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("t")))), lambda x: x.t), "; ").alias("changes"))


def weighted_centroids(cen: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Centroids of higher levels: means of centroids by weight, summed by task before the shuffle."""
    return cen.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("centroid")), F.col(weight).cast("double"))).alias("centroid"))


def centroid_pairs(cen: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Cosine distance of each pair of entities with centroids in the same group of keys."""
    a, b = cen.select(*keys, F.col(entity).alias("a"), F.col("centroid").alias("x")), cen.select(*keys, F.col(entity).alias("b"), F.col("centroid").alias("y"))
    return a.join(b, keys).where("a < b").select(*keys, "a", "b", cosine_distance("x", "y").alias("d"))


def padded_extent(points: DataFrame, keys: list[str], x: str, y: str, pad: float = 0.05) -> DataFrame:
    """Bounds of each group's points with a margin that is a share of the range."""
    out = []
    for c in (x, y):
        low, high = F.min(c), F.max(c)
        out += [(low - pad * (high - low)).alias(f"{c}_low"), (high + pad * (high - low)).alias(f"{c}_high")]
    return points.groupBy(*keys).agg(*out)


def centred(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Points about the median of their group, scaled by the 95th percentile of the radius."""
    mid = points.groupBy(*keys).agg(F.median(x).alias("_mx"), F.median(y).alias("_my"))
    p = points.join(mid, keys).withColumns({x: F.col(x) - F.col("_mx"), y: F.col(y) - F.col("_my")}).drop("_mx", "_my")
    p = p.withColumn("radius", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    r = p.groupBy(*keys).agg(F.percentile("radius", F.lit(0.95)).alias("_r"))
    return p.join(r, keys).withColumns({c: ratio(F.col(c), F.col("_r")) for c in (x, y, "radius")}).drop("_r")


def radial_shape(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Tail and spread of the radius, share of outliers beyond 1.5 IQR, and elongation of the covariance ellipse."""
    q = F.percentile("radius", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    p = centred(points, keys, x, y)
    s = p.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q"), F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    iqr = F.col("q")[2] - F.col("q")[0]
    far = p.join(s.select(*keys, (F.col("q")[2] + 1.5 * iqr).alias("edge")), keys).groupBy(*keys).agg(F.avg((F.col("radius") > F.col("edge")).cast("double")).alias("outlier_share"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 4 + F.col("c") * F.col("c"))
    return s.join(far, keys).select(*keys, "n", ratio(F.col("q")[3], F.col("q")[1]).alias("tail"), ratio(iqr, F.col("q")[1]).alias("spread"), "outlier_share", F.sqrt(ratio(half + root, half - root)).alias("elongation"))


def window_means(points: DataFrame, windows: DataFrame, x: str, y: str) -> DataFrame:
    """The mean point of each window, a row for every window."""
    m = points.groupBy("window_index").agg(F.count("*").alias("n"), F.avg(x).alias(x), F.avg(y).alias(y))
    return windows.select("window_index", "window_label").join(m, "window_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
