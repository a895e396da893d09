"""Groups of profiles: prototypes, margins, names, quality indices, model choice and blends of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..functions.vec import centroids, euclid
from .cluster import contingency


def own_and_other(points: DataFrame, id_: str, cluster: str, vector: str) -> DataFrame:
    """Distance of each point to its own and to the nearest other centre, the margin, and which points are prototypes.

    Centres are few (one for each cluster), so the join with them has as many rows as points times clusters.
    """
    c = centroids(points, [cluster], vector).select(F.col(cluster).alias("_c"), "centroid")
    d = points.select(id_, cluster, vector).crossJoin(F.broadcast(c)).select(id_, cluster, "_c", euclid(vector, "centroid").alias("d"))  # a row for each cluster
    out = d.groupBy(id_, cluster).agg(F.min(F.when(F.col("_c") == F.col(cluster), F.col("d"))).alias("own"), F.min(F.when(F.col("_c") != F.col(cluster), F.col("d"))).alias("other"))
    best = out.groupBy(cluster).agg(F.min_by(id_, F.struct("own", id_)).alias("_best"))
    return out.join(F.broadcast(best), cluster).select(id_, cluster, "own", "other", (F.col("other") - F.col("own")).alias("margin"), (F.col(id_) == F.col("_best")).alias("prototype"))


def calinski_harabasz(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Between to within dispersion from sums by component; NULL for one cluster or as many as points."""
    x = points.select(F.col(cluster).alias("c"), F.posexplode(vector).alias("d", "x"))
    part = x.groupBy("c", "d").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    all_ = part.groupBy("d").agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("t")).select("d", (F.col("s") / F.col("t")).alias("g"))
    gap = F.col("m") - F.col("g")
    one = part.join(all_, "d").agg(F.sum(F.col("n") * gap * gap).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count_distinct("c").alias("k"), F.sum(F.when(F.col("d") == 0, F.col("n"))).alias("n"))
    score = ratio(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return one.select("k", "n", F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), score).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to the distance of centres; lower is better."""
    c = centroids(points, [cluster], vector)
    s = points.select(cluster, vector).join(F.broadcast(c), cluster).groupBy(cluster).agg(F.avg(euclid(vector, "centroid")).alias("s"))
    t = c.join(s, cluster)
    a, b = t.toDF("a", "ca", "sa"), t.toDF("b", "cb", "sb")
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(ratio(F.col("sa") + F.col("sb"), euclid("ca", "cb"))).alias("worst"))  # pairs of clusters
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of the entropies, 1 where both labellings have one class."""
    t = contingency(df, a, b)
    n, ra, rb = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b))
    p = t.withColumns({"t": n, "ra": ra, "rb": rb})  # pairs of labels
    share = F.col("n") / F.col("t")
    one = p.agg(F.sum(share * F.ln(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mi"), F.sum(-share * F.ln(F.col("ra") / F.col("t"))).alias("ha"), F.sum(-share * F.ln(F.col("rb") / F.col("t"))).alias("hb"))
    return one.select("mi", "ha", "hb", F.coalesce(ratio(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"))


def dominant(df: DataFrame, cluster: str, domain: str) -> DataFrame:
    """Size of each cluster, its commonest domain (ties by name) and that domain's share."""
    t = contingency(df, cluster, domain).withColumn("_o", F.struct(-F.col("n"), F.col(domain)))
    return t.groupBy(cluster).agg(F.sum("n").alias("size"), F.min_by(domain, "_o").alias("dominant"), (F.max("n") / F.sum("n")).alias("dominant_share"))


def shares_both_ways(df: DataFrame, cluster: str, domain: str) -> DataFrame:
    """Counts of label pairs with the share within the cluster and within the domain."""
    t = contingency(df, cluster, domain)
    of = lambda c: F.col("n") / F.sum("n").over(Window.partitionBy(c))
    return t.select(cluster, domain, "n", of(cluster).alias("share_of_cluster"), of(domain).alias("share_of_domain"))


def traits(long: DataFrame, cluster: str, n: int = 3) -> DataFrame:
    """The n strongest metrics of each cluster by its mean of scaled values, upwards and downwards."""
    mean = long.groupBy(cluster, "metric").agg(F.avg("scaled").alias("mean")).where("mean is not null")
    out = None
    for name, order in (("high", F.col("mean").desc()), ("low", F.col("mean"))):
        w = Window.partitionBy(cluster).orderBy(order, "metric")
        one = mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("side", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def named(means: DataFrame, cluster: str, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """A name for each cluster: rules (name, metric, highest) in order each take the best cluster that has none yet.

    One row for each cluster; each rule is one pass over them, without collecting.
    """
    out = means.withColumn("name", F.lit(None).cast("string"))
    for name, metric, highest in rules:
        best = F.col(metric).desc_nulls_last() if highest else F.col(metric).asc_nulls_last()
        w = Window.orderBy(F.col("name").isNotNull(), best, cluster)
        out = out.withColumn("_r", F.row_number().over(w)).withColumn("name", F.coalesce("name", F.when(F.col("_r") == 1, name))).drop("_r")
    return out


def choose(models: DataFrame, least: int, most: float, n: int) -> DataFrame:
    """Models by silhouette among the balanced ones (smallest and largest cluster within bounds), or all if none is."""
    fine = (F.col("min_size") >= least) & (F.col("max_size") <= max(30.0, most * n))
    some = F.max(fine).over(Window.partitionBy())
    kept = models.withColumns({"balanced": fine, "_some": some}).where("balanced or not _some").drop("_some")  # a row for each model
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.col("silhouette").desc_nulls_last(), "k", "method")))


def normalised(pairs: DataFrame, value: str) -> DataFrame:
    """Distances divided by their mean within the level."""
    return pairs.withColumn(value, ratio(F.col(value), F.avg(value).over(Window.partitionBy("level"))))


def blended(a: DataFrame, b: DataFrame, value: str, weight: float) -> DataFrame:
    """weight * a + (1 - weight) * b over the pairs of both tables, each normalised first."""
    x, y = normalised(a, value).select("level", "a", "b", F.col(value).alias("x")), normalised(b, value).select("level", "a", "b", F.col(value).alias("y"))
    return x.join(y, ["level", "a", "b"]).select("level", "a", "b", (weight * F.col("x") + (1 - weight) * F.col("y")).alias(value))


def domain_gaps(pairs: DataFrame, domain: DataFrame, value: str) -> DataFrame:
    """Median distance by unordered pair of domains; domain has entity and domain."""
    left, right = domain.toDF("a", "da"), domain.toDF("b", "db")
    j = pairs.join(left, "a").join(right, "b")
    return j.groupBy(F.least("da", "db").alias("domain_a"), F.greatest("da", "db").alias("domain_b")).agg(F.count("*").alias("n_pairs"), F.median(value).alias("median_distance"))


def moved(a, b, twice: float = 2.0) -> Column:
    """Which side of a pair moved: mostly one (at least twice the other), or both."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), "unavailable").when(F.greatest(a, b) <= 1e-12, "neither").when(F.col(a) >= twice * F.col(b), "mostly_a").when(F.col(b) >= twice * F.col(a), "mostly_b").otherwise("both_move")
