"""Summaries over profiles, changes, coverage and neighbours, and comparisons of two sets of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import correlation, mean_rank, ratio, share


def directional(changes: DataFrame, value: str, ties: list[str], n: int) -> DataFrame:
    """The n strongest falls and the n strongest rises, ranked; rows without a change are in neither."""
    side = F.when(F.col(value) < 0, "converging").when(F.col(value) > 0, "diverging")
    w = Window.partitionBy("side").orderBy(F.abs(value).desc(), *ties)  # tasks keep n rows of each side before the shuffle
    return changes.withColumn("side", side).where("side is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def retention(long: DataFrame, entity: str, last: int, least: int = 2) -> DataFrame:
    """Which entities have enough values in both end windows, and why the others go."""
    at = lambda w: F.count(F.when(F.col("window_index") == w, F.col("value")))
    n = long.groupBy(entity).agg(at(0).alias("n_first"), at(last).alias("n_last"))
    a, b = F.col("n_first") >= least, F.col("n_last") >= least
    return n.withColumns({"kept": a & b, "reason": F.when(a & b, "kept").when(b, "first_window").when(a, "last_window").otherwise("both_windows")})


def coverage_totals(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, complete cells, planned and present rows and the shortfall by keys; keys that are NULL are one group."""
    s = coverage.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count_if(F.col("shortfall") == 0).alias("n_complete"), *(F.sum(c).alias(c) for c in ("planned", "present", "shortfall")))
    return s.withColumn("coverage", share(F.col("present"), F.col("planned")))


def sign_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count_if(v > 0).alias("n_up"), F.count_if(v < 0).alias("n_down"), F.count_if(v == 0).alias("n_flat"), F.min(v).alias("least"), F.max(v).alias("most"))


def against_all(long: DataFrame, cluster: str) -> DataFrame:
    """Mean and median of each metric by cluster, and the mean's z against all rows of the metric."""
    all_ = long.groupBy("metric").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    own = long.groupBy(cluster, "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))
    return own.join(F.broadcast(all_), "metric").select(cluster, "metric", "mean", "median", ratio(F.col("mean") - F.col("_m"), F.col("_s")).alias("z"))  # a row for each metric


def information(long: DataFrame, high_missing: float = 0.3, few: int = 3, zeros: float = 0.8) -> DataFrame:
    """Missing, zero and unique shares of each metric, and the flag that tells why it says little."""
    n, have = F.count("*"), F.count("value")
    s = long.groupBy("metric").agg(n.alias("n"), (1 - have / n).alias("missing_share"), F.count_distinct("value").alias("n_unique"), share(F.count_if(F.col("value") == 0), have).alias("zero_share"), share(F.count_distinct("value"), have).alias("unique_share"))
    flag = F.when(F.col("missing_share") >= high_missing, "missing").when(F.col("n_unique") <= few, "constant").when(F.col("zero_share") >= zeros, "zero_dominated").otherwise("fine")
    return s.withColumn("flag", flag)


def cross_correlations(long: DataFrame, id_: str, left: list[str], right: list[str]) -> DataFrame:
    """Pearson and Spearman of each left with each right metric, over the ids that have both."""
    x = long.where("value is not null")
    a, b = x.where(F.col("metric").isin(left)).select(id_, F.col("metric").alias("a"), F.col("value").alias("x")), x.where(F.col("metric").isin(right)).select(id_, F.col("metric").alias("b"), F.col("value").alias("y"))
    r = a.join(b, id_).withColumns({"rx": mean_rank("x", "a", "b"), "ry": mean_rank("y", "a", "b")})
    return r.groupBy("a", "b").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"), correlation(F.col("rx"), F.col("ry")).alias("spearman"))


def imputed(long: DataFrame, id_: str, high_missing: float = 0.3, few: int = 1) -> DataFrame:
    """Values with the metric's median where missing, standardised; metrics that mostly miss or never vary go."""
    fit = long.groupBy("metric").agg(F.median("value").alias("_q"), (1 - F.count("value") / F.count("*")).alias("_miss"), F.count_distinct("value").alias("_u"))
    kept = fit.where((F.col("_miss") < high_missing) & (F.col("_u") > few))
    full = long.join(F.broadcast(kept), "metric").select(id_, "metric", F.coalesce("value", "_q").alias("value"))  # a row for each metric
    par = full.groupBy("metric").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return full.join(F.broadcast(par), "metric").select(id_, "metric", "value", F.coalesce(ratio(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0)).alias("z"))


def family_balanced(long: DataFrame, families: dict[str, str]) -> DataFrame:
    """Scaled values over the root of the number of metrics in their family, so that families weigh alike."""
    size = {f: sum(1 for x in families.values() if x == f) for f in families.values()}
    weight = F.create_map(*(F.lit(v) for m, f in families.items() for v in (m, size[f] ** -0.5)))
    return long.withColumn("scaled", F.col("scaled") * F.try_element_at(weight, F.col("metric")))


def compared(a: DataFrame, b: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Rows that both tables have: both values, the change, both ranks in the group and the better rank."""
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    rank = lambda c: F.rank().over(Window.partitionBy(group).orderBy(c))
    j = x.join(y, keys).withColumns({"delta": F.col("y") - F.col("x"), "rank_x": rank("x"), "rank_y": rank("y")})
    return j.withColumn("best_rank", F.least("rank_x", "rank_y"))


def agreement(pairs: DataFrame, group: str) -> DataFrame:
    """Pearson and Spearman of x and y in each group."""
    r = pairs.where("x is not null and y is not null").withColumns({"rx": mean_rank("x", group), "ry": mean_rank("y", group)})
    return r.groupBy(group).agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"), correlation(F.col("rx"), F.col("ry")).alias("spearman"))


def ends(long: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    """The entities with the lowest and the highest value, ties by name."""
    some = long.where(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(F.min_by(entity, F.struct(value, entity)).alias("lowest"), F.min_by(entity, F.struct(-F.col(value), F.col(entity))).alias("highest"))


def kth_neighbour(near: DataFrame, group: str, k: int) -> DataFrame:
    """Median and variation of the distance to the k-th neighbour; vectors with fewer neighbours count by their last."""
    last = near.where(F.col("rank") <= k).groupBy(group, "src").agg(F.max_by("d", "rank").alias("d"))
    return last.groupBy(group).agg(F.count("*").alias("n"), F.median("d").alias("median_kth"), ratio(F.stddev_pop("d"), F.avg("d")).alias("cv_kth"))


def yearly_path(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Path of the yearly median points: drift, length, variation of the steps, and the trend of the median radius."""
    w = Window.partitionBy(*keys).orderBy("year")
    gap = lambda a, b, c, d: F.sqrt((F.col(a) - F.col(c)) ** 2 + (F.col(b) - F.col(d)) ** 2)
    m = points.groupBy(*keys, "year").agg(F.median(x).alias("mx"), F.median(y).alias("my"), F.median(F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))).alias("r"))
    s = m.withColumns({"px": F.lag("mx").over(w), "py": F.lag("my").over(w)}).withColumn("step", gap("mx", "my", "px", "py"))
    first, last = F.min_by(F.struct("mx", "my"), "year"), F.max_by(F.struct("mx", "my"), "year")
    t = s.groupBy(*keys).agg(F.count("*").alias("n_years"), F.sum("step").alias("path"), ratio(F.stddev_pop("step"), F.avg("step")).alias("step_cv"), first.alias("a"), last.alias("z"), F.when(F.count("*") > 1, F.regr_slope("r", "year")).alias("radial_slope"), correlation(F.col("r"), F.col("year").cast("double")).alias("c"))
    return t.select(*keys, "n_years", gap("a.mx", "a.my", "z.mx", "z.my").alias("drift"), "path", "step_cv", "radial_slope", (F.col("c") * F.col("c")).alias("radial_r2"))


def matrix_checks(vectors: DataFrame, id_: str, vector: str, dim: int) -> DataFrame:
    """Rows, rows of another dimension, repeated ids, and whether the ids run without a gap. One pass; NULL ids count as repeated."""
    n, u = F.count("*"), F.count_distinct(id_)
    return vectors.agg(n.alias("n"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dim).alias("wrong_dimension"), (n - u).alias("repeated"), F.coalesce(F.max(id_) - F.min(id_) + 1 == u, F.lit(True)).alias("contiguous"))


def share_pivot(df: DataFrame, cluster: str, domain: str, domains: list) -> DataFrame:
    """A row for each cluster, a column for each listed domain with its share of the cluster."""
    n = df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.count_if(F.col(domain) == v).alias(f"share_{v}") for v in domains))
    return n.select(cluster, "n", *(ratio(F.col(f"share_{v}"), F.col("n")).alias(f"share_{v}") for v in domains))


def ranked_first(df: DataFrame, ranking: DataFrame, id_: str, order: list[Column], n: int) -> DataFrame:
    """Rows of the n best ids of a ranking, with the place of each; n is the size of the report."""
    top = ranking.orderBy(*order, id_).limit(n)
    place = top.select(id_, F.row_number().over(Window.orderBy(*order, id_)).alias("place"))  # n rows
    return df.join(F.broadcast(place), id_)
