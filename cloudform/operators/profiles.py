"""Profiles of entities, distances between them, rankings and convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import correlation, robust


def by_levels(table: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Each row once for each level, with the level and the row's entity there; one pass over the table."""
    keys = F.array(*(F.struct(F.lit(name).alias("level"), key.cast("string").alias("entity")) for name, key in levels.items()))
    return table.withColumn("_k", F.explode(keys)).withColumns({"level": F.col("_k.level"), "entity": F.col("_k.entity")}).drop("_k")


def level_profiles(table: DataFrame, levels: dict[str, Column], metrics: list[str]) -> DataFrame:
    """Mean of the raw metrics for each entity of each level, and how many rows it has."""
    return by_levels(table, levels).groupBy("level", "entity").agg(F.count("*").alias("n_rows"), *(F.avg(m).alias(m) for m in metrics))


def scaled(profiles: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form, scaled by median and IQR in each level (by the standard deviation where the IQR is nothing)."""
    long = profiles.unpivot(["level", "entity"], metrics, "metric", "value")
    q = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    par = long.groupBy("level", "metric").agg(q.alias("q"), F.stddev_pop("value").alias("s"))
    spread = F.when(F.col("s") > 1e-12, (F.col("value") - F.col("q")[1]) / F.col("s"))
    return long.join(F.broadcast(par), ["level", "metric"]).select("level", "entity", "metric", "value", F.coalesce(robust(F.col("value"), F.col("q")), spread).alias("scaled"))  # a row for each metric and level


def distances(long: DataFrame, least: int = 2) -> DataFrame:
    """Euclidean and correlation distance of each pair of entities of a level, over the metrics that both have."""
    x = long.where("scaled is not null")
    a, b = x.select("level", "metric", F.col("entity").alias("a"), F.col("scaled").alias("x")), x.select("level", "metric", F.col("entity").alias("b"), F.col("scaled").alias("y"))
    pairs = a.join(b, ["level", "metric"]).where("a < b")
    d = F.col("x") - F.col("y")
    out = pairs.groupBy("level", "a", "b").agg(F.count("*").alias("n_metrics"), F.sqrt(F.sum(d * d)).alias("euclid"), (1 - correlation(F.col("x"), F.col("y"))).alias("corr"))
    return out.where(F.col("n_metrics") >= least)


def extremes(df: DataFrame, keys: list[str], value: str, ties: list[str], n: int, *, largest: bool = False) -> DataFrame:
    """The n lowest and n highest rows of each group, with direction and rank; with `largest`, those of the largest absolute value too."""
    orders = {"lowest": F.col(value).asc(), "highest": F.col(value).desc()} | ({"largest": F.abs(value).desc()} if largest else {})
    out = None
    for name, order in orders.items():
        one = df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))).where(F.col("rank") <= n).withColumn("direction", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def nearest(pairs: DataFrame, value: str = "euclid") -> DataFrame:
    both = pairs.select("level", F.col("a").alias("entity"), F.col("b").alias("other"), value).union(pairs.select("level", "b", "a", value))
    return both.groupBy("level", "entity").agg(F.min_by("other", F.struct(value, "other")).alias("nearest"), F.min(value).alias("distance"))


def square(pairs: DataFrame, value: str = "euclid", keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """The symmetric matrix of each group of keys with a zero diagonal, a row for each entity: others in order and values alike."""
    ids = pairs.select(*keys, F.col("a").alias("entity")).union(pairs.select(*keys, "b")).distinct()
    cells = pairs.select(*keys, F.col("a").alias("entity"), F.col("b").alias("other"), F.col(value).alias("d"))
    cells = cells.union(pairs.select(*keys, "b", "a", value)).union(ids.select(*keys, "entity", "entity", F.lit(0.0)))
    rows = cells.groupBy(*keys, "entity").agg(F.array_sort(F.collect_list(F.struct("other", "d"))).alias("_r"))
    return rows.select(*keys, "entity", F.transform("_r", lambda x: x.other).alias("others"), F.transform("_r", lambda x: x.d).alias("values"))


def distance_changes(long: DataFrame, last: int) -> DataFrame:
    """Of each pair: Euclidean distance in the first and last window and its change; long has a column window_index."""
    a = long.where("scaled is not null").select("window_index", "metric", F.col("entity").alias("a"), F.col("scaled").alias("x"))
    b = a.select("window_index", "metric", F.col("a").alias("b"), F.col("x").alias("y"))
    d = F.col("x") - F.col("y")
    per = a.join(b, ["window_index", "metric"]).where("a < b").groupBy("window_index", "a", "b").agg(F.sqrt(F.sum(d * d)).alias("d"))
    at = lambda w: F.max(F.when(F.col("window_index") == w, F.col("d")))
    out = per.groupBy("a", "b").agg(F.count("*").alias("n_windows"), at(0).alias("first_distance"), at(last).alias("last_distance"))
    delta = F.col("last_distance") - F.col("first_distance")
    return out.select("*", delta.alias("delta"), F.when(delta < 0, "converging").when(delta > 0, "diverging").alias("direction"))


# ---------------------------------------------------------------- rows that were scaled before they are summarised
def level_means(scaled_rows: DataFrame, levels: dict[str, Column], entity: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of scaled values for each entity of each level, metric and keys (such as a window), and how many entities of the rows."""
    out = by_levels(scaled_rows, levels).groupBy("level", *keys, "entity", "metric").agg(F.avg("scaled").alias("scaled"), F.count_distinct(entity).alias("n_entities"))
    return out.select("level", *keys, "entity", "metric", "scaled", "n_entities")


def similarities(long: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Euclidean and correlation distance of each pair of entities within keys, over the metrics that both have.

    The Euclidean distance needs one metric, the correlation distance two. Without spread in a profile it is 0 if both
    are alike, else NULL.
    """
    x = long.where("scaled is not null")
    a, b = x.select(*keys, "metric", F.col("entity").alias("a"), F.col("scaled").alias("x")), x.select(*keys, "metric", F.col("entity").alias("b"), F.col("scaled").alias("y"))
    d = F.col("x") - F.col("y")
    out = a.join(b, [*keys, "metric"]).where("a < b").groupBy(*keys, "a", "b").agg(
        F.count("*").alias("n_metrics"), F.sqrt(F.sum(d * d)).alias("euclid"), correlation(F.col("x"), F.col("y")).alias("_r"), F.max(F.abs(d) - 1e-5 * F.abs("y")).alias("_gap"))
    corr = F.when(F.col("n_metrics") < 2, None).when(F.col("_r").isNotNull(), 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r")))).when(F.col("_gap") <= 1e-8, 0.0)
    return out.withColumn("corr", corr).drop("_r", "_gap")


def pair_changes(pairs: DataFrame, value: str, last: int, keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """Of each pair over its windows: first and last distance, change, slope by window and direction."""
    known = pairs.where(F.col(value).isNotNull())
    at = lambda w: F.max(F.when(F.col("window_index") == w, F.col(value)))
    out = known.groupBy(*keys, "a", "b").agg(F.count("*").alias("n_windows"), at(0).alias("first_distance"), at(last).alias("last_distance"), F.when(F.count("*") > 1, F.regr_slope(value, "window_index")).alias("slope"))
    delta = F.col("last_distance") - F.col("first_distance")
    return out.select("*", delta.alias("delta"), F.when(delta < 0, "converging").when(delta > 0, "diverging").when(delta == 0, "unchanged").alias("direction"))


def pair_key(a: str, b: str) -> Column:
    """The same text for both orders of a pair."""
    return F.array_join(F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string"))), "__")


def closest_and_farthest(pairs: DataFrame, keys: tuple[str, ...], value: str, n: int) -> DataFrame:
    """The report of the n closest and n farthest pairs: keys, pair, the order-free key, value, rank and side."""
    out = extremes(pairs, list(keys), value, ["a", "b"], n)
    side = F.when(F.col("direction") == "lowest", "closest").otherwise("farthest")
    return out.select(*keys, side.alias("side"), "rank", pair_key("a", "b").alias("pair"), "a", "b", F.col(value).alias("distance"))


def edge_list(changes: DataFrame, movement: DataFrame, n: int) -> DataFrame:
    """Edges of the n strongest approaches and n strongest departures, with the movement of both ends."""
    top = extremes(changes, [], "delta", ["a", "b"], n) if n else changes
    m = movement.select("entity", "movement")
    out = top.join(m.toDF("a", "movement_a"), "a", "left").join(m.toDF("b", "movement_b"), "b", "left")
    return out.select("a", "b", F.when(F.col("delta") < 0, "approach").otherwise("departure").alias("kind"), F.abs("delta").alias("weight"), "movement_a", "movement_b")
