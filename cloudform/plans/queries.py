"""Queries over the engine's operators; each takes a session and a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.num import correlation, mean_rank, skew
from ..operators import cloud, cluster, corpus, density, profiles, quantiles, rows, temporal
from ..sources.scratch import settle
from ..streaming import acceptance

FIRST, LAST = 2000, 2024
METRICS = ["mean_distance", "median_distance", "iqr_distance", "p90_distance"]
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark, d, name):
    """A table of the folder; its schema is read from the files once in a session."""
    path = f"{d}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in SCHEMAS:
        SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[key]).parquet(path)


def vectors(spark, d) -> DataFrame:
    """embeddings as rows of a three-level hierarchy with a year."""
    v = table(spark, d, "embeddings")
    v = v.select(F.col("vec_id").alias("work_id"), F.col("label").alias("l1"), F.expr("cast(label div 3 as int)").alias("l2"), F.expr("cast(label div 6 as int)").alias("l3"), (FIRST + F.col("vec_id") % 25).cast("int").alias("year"), "embedding")
    return cloud.unit_rows(v)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sizes(spark, d, times=1):
    """How many vectors, or `times` as many, each l1 has at most."""
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("l1")).agg((F.count("*") * times).alias("n"))


@query
def cloud_dispersion(spark, d):
    return rounded(cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)))


def near(spark, d):
    v = vectors(spark, d)
    return v, cloud.neighbours(v, "l1", "work_id", 5, sizes(spark, d))


@query
def cloud_knn_stats(spark, d):
    return rounded(cloud.neighbour_stats(near(spark, d)[1], "l1", sizes(spark, d, 5)))


@query
def cloud_hub_gini(spark, d):
    v, knn = near(spark, d)
    return rounded(cloud.hub_gini(v, knn, "l1", "work_id"))


@query
def cloud_graph_edges(spark, d):
    e = settle(cloud.graph_edges(near(spark, d)[1], "l1"))
    q = quantiles.group_percentiles(e, ["l1"], "d", [0.5, 0.9], sizes=sizes(spark, d, 5))
    return rounded(e.groupBy("l1").agg(F.count("*").alias("n_edges")).join(q, "l1").select("l1", "n_edges", F.col("q")[0].alias("median_edge"), F.col("q")[1].alias("p90_edge")))


@query
def cloud_graph_components(spark, d):
    v, knn = near(spark, d)
    return rounded(cloud.graph_components(v, cloud.graph_edges(knn, "l1"), "l1", "work_id"))


@query
def cloud_spectrum(spark, d):
    return rounded(cloud.spectrum(vectors(spark, d), "l1", sizes(spark, d)))


@query
def cloud_drift(spark, d):
    return rounded(cloud.drift(vectors(spark, d), "l1", FIRST, LAST))


@query
def cloud_drift_short(spark, d):
    """Over eight years, where both edges share two."""
    return rounded(cloud.drift(vectors(spark, d), "l1", 2003, 2010))


@query
def cloud_annual_path(spark, d):
    return rounded(cloud.annual_path(vectors(spark, d), "l2"))


@query
def entity_centroid_unit(spark, d):
    c = cloud.unit_centroids(vectors(spark, d), ["l1"])
    return rounded(c.select("l1", F.posexplode("centroid").alias("dim", "x")))


def win(spark, d):
    """The table of metrics by window: few rows that several branches of a query use, so it is settled once."""
    return settle(temporal.window_metrics(vectors(spark, d), temporal.windows(spark, FIRST, LAST), "l1", 3, FIRST, LAST, sizes=sizes(spark, d)))


SPECTRAL = ("d80", "entropy")


def full_windows(spark, d, metrics=rows.WINDOW_METRICS):
    return rows.window_group_metrics(vectors(spark, d), temporal.windows(spark, FIRST, LAST), "l1", "work_id", 5, 3, FIRST, LAST, metrics=metrics)


@query
def window_metrics(spark, d):
    """The window metrics that SQL can tell; window_spectra has the others."""
    some = tuple(m for m in rows.WINDOW_METRICS if m not in SPECTRAL)
    return rounded(full_windows(spark, d, some).select("l1", "window_index", "window_label", "n", "status", *some))


@query
def window_spectra(spark, d):
    return rounded(full_windows(spark, d).select("l1", "window_index", *SPECTRAL))


@query
def metric_long_scaled(spark, d):
    return rounded(temporal.long_scaled(win(spark, d), "l1", METRICS).drop("mid_year"), 5)


def change(spark, d):
    return temporal.changes(temporal.long_scaled(win(spark, d), "l1", METRICS), "l1", 5)


@query
def metric_changes(spark, d):
    return rounded(change(spark, d), 5)


@query
def change_ranking(spark, d):
    return rounded(temporal.change_ranking(change(spark, d), "l1"), 5)


@query
def top_changes(spark, d):
    return rounded(profiles.extremes(change(spark, d).select("l1", "metric", "delta_z"), ["metric"], "delta_z", ["l1"], 3, largest=True), 5)


@query
def metric_trajectories(spark, d):
    long = temporal.long_scaled(win(spark, d), "l1", METRICS).withColumn("l2", F.expr("cast(l1 div 3 as int)"))
    return rounded(long.groupBy("l2", "window_index", "metric").agg(F.avg("value").alias("mean_value"), F.median("value").alias("median_value"), F.avg("z").alias("mean_z"), F.median("z").alias("median_z"), F.count_distinct("l1").alias("n_entities")))


@query
def window_sample_sizes(spark, d):
    q = F.percentile("n", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    out = win(spark, d).groupBy("window_index").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.min("n").alias("least"), q.alias("q"), F.max("n").alias("most"))
    return rounded(out.select("window_index", "completed", "least", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "most"))


def walk(spark, d):
    return temporal.paths(temporal.window_centroids(vectors(spark, d), "l1", 3, FIRST, LAST), "l1")


@query
def window_centroid_paths(spark, d):
    return rounded(walk(spark, d))


@query
def movement_by_level(spark, d):
    return rounded(temporal.by_level(walk(spark, d), F.expr("cast(l1 div 3 as int)"), ["path", "drift"]))


@query
def largest_jump_hist(spark, d):
    n = walk(spark, d).groupBy(F.col("largest_step_window").alias("window_index")).count()
    out = temporal.windows(spark, FIRST, LAST).select("window_index", "window_label").join(n, "window_index", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    total = out.agg(F.sum("n").alias("total"))
    return rounded(out.crossJoin(F.broadcast(total)).select("window_index", "window_label", "n", (F.col("n") / F.greatest("total", F.lit(1))).alias("share")))  # one row


def raw_profiles(spark, d):
    t = settle(cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)))
    return profiles.level_profiles(t, {"l1": F.col("l1"), "l2": F.expr("l1 div 3"), "l3": F.expr("l1 div 6")}, METRICS)


@query
def profile_table_raw(spark, d):
    return rounded(raw_profiles(spark, d))


@query
def profile_rankings(spark, d):
    long = raw_profiles(spark, d).unpivot(["level", "entity"], METRICS, "metric", "value")
    return rounded(profiles.extremes(long, ["level", "metric"], "value", ["entity"], 2))


def static_pairs(spark, d):
    return profiles.distances(profiles.scaled(raw_profiles(spark, d), METRICS))


@query
def profile_distances_static(spark, d):
    return rounded(static_pairs(spark, d), 5)


@query
def profile_pairs_top(spark, d):
    return rounded(profiles.extremes(static_pairs(spark, d).select("level", "a", "b", "euclid"), ["level"], "euclid", ["a", "b"], 3), 5)


@query
def nearest_profile(spark, d):
    return rounded(profiles.nearest(static_pairs(spark, d)), 5)


@query
def distance_matrix(spark, d):
    m = profiles.square(static_pairs(spark, d)).select("level", "entity", F.explode(F.arrays_zip("others", "values")).alias("x"))
    return rounded(m.select("level", "entity", F.col("x.others").alias("other"), F.col("x.values").alias("d")), 5)


@query
def distance_changes(spark, d):
    long = temporal.long_scaled(win(spark, d), "l1", METRICS).select("window_index", "metric", F.col("l1").cast("string").alias("entity"), F.col("rz").alias("scaled"))
    return rounded(profiles.distance_changes(long, 4), 5)


@query
def pair_entity_frequency(spark, d):
    c = distance_changes(spark, d).where("direction is not null")
    sides = c.select(F.explode(F.array("a", "b")).alias("entity"), "direction", "delta")
    return rounded(sides.groupBy("entity").agg(F.count_if(F.col("direction") == "converging").alias("converging"), F.count_if(F.col("direction") == "diverging").alias("diverging"), F.avg("delta").alias("mean_delta"), F.median(F.abs("delta")).alias("median_change")), 4)


def order_years(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "c_mktsegment", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")


def counts(spark, d):
    f = {"n_all": F.lit(True), "n_closed": F.col("o_orderstatus") == "F", "n_large": (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)}
    return corpus.dense_counts(order_years(spark, d), ["c_nationkey", "c_mktsegment"], f, 1995, 2001)


@query
def year_counts_dense(spark, d):
    return counts(spark, d)


@query
def annual_coverage(spark, d):
    return rounded(corpus.annual_coverage(counts(spark, d), ["c_nationkey", "c_mktsegment"], "n_all", 5))


@query
def corpus_plan(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t = counts(spark, d).groupBy("c_nationkey").agg(F.sum("n_all").alias("n_all"), F.sum("n_closed").alias("n_closed"))
    out = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(t, n.n_nationkey == t.c_nationkey, "left").na.fill(0, ["n_all", "n_closed"])
    total = out.groupBy("n_regionkey").agg(F.sum("n_all").alias("region_all"))
    e = corpus.eligibility(F.col("n_all"), 60, 40)
    return rounded(out.join(total, "n_regionkey").select("n_nationkey", "n_name", "r_name", "n_all", F.when(F.col("n_all") > 0, F.col("n_closed") / F.col("n_all")).otherwise(0.0).alias("closed_share"), F.when(F.col("region_all") > 0, F.col("n_all") / F.col("region_all")).otherwise(0.0).alias("region_share"), e["reason"].alias("reason")))


@query
def sample_plan(spark, d):
    return corpus.sample_plan(counts(spark, d).select("c_nationkey", "c_mktsegment", "year", "n_all"), "n_all", 5, 1.75)


@query
def quota_redistribution(spark, d):
    t = counts(spark, d).groupBy("c_nationkey", "year").agg(F.sum("n_all").alias("n"))
    return corpus.redistribute(t, "c_nationkey", "n", 70, 10)


@query
def cell_coverage(spark, d):
    plan = corpus.sample_plan(counts(spark, d), "n_all", 5, 1.75)
    return rounded(corpus.coverage(plan, order_years(spark, d).where("o_orderstatus = 'F'"), ["c_nationkey", "c_mktsegment", "year"]))


@query
def labels_display(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return corpus.labels(n.join(r, n.n_regionkey == r.r_regionkey), "n_nationkey", "n_name", "r_name")


@query
def docs_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.token_count("text").cast("long").alias("n_tokens"))


@query
def docs_quality_counters(spark, d):
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return corpus.quality_counters(j, {"missing_text": blank("text"), "missing_source": blank("source"), "other_language": F.col("lang") != "en", "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200}, "doc_id")


@query
def json_validity(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNull()).alias("invalid"))


@query
def abstract_rebuild(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return corpus.inverted_index(docs, "doc_id", "text").select("doc_id", F.md5(corpus.rebuilt("index")).alias("digest"))


@query
def resume_pending(spark, d):
    ev = table(spark, d, "events")
    plan = ev.select("user_id", "event_type").distinct()
    done = ev.select("user_id", "event_type", F.when(F.col("value") > 120, "completed").when(F.col("value") > 100, "failed").otherwise("partial").alias("status"))
    return corpus.pending(plan, done, ["user_id", "event_type"], ("completed",))


@query
def accept_capped(spark, d):
    ev = table(spark, d, "events")
    return corpus.accept(ev, "event_id", ["user_id", "event_type"], "user_id", ["ts", "event_id"], 2, 5).select("event_id", "user_id", "event_type", "decision")


@query
def accept_shared_ids(spark, d):
    """Parts offered by suppliers by year: a part enters once, in the first cell with room."""
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    plan = li.groupBy("l_suppkey", "year").agg(F.ceil(F.count("*") / 2).cast("long").alias("planned"))
    out = corpus.accept(li, "l_partkey", ["l_suppkey", "year"], "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], plan, 100)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "decision")


@query
def status_histogram(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query
def balanced_sample_size(spark, d):
    return corpus.balanced(vectors(spark, d), "l1", "work_id", 30, 7).groupBy("l1").agg(F.count("*").alias("n"))


@query
def index_audit(spark, d):
    v, docs = table(spark, d, "embeddings"), table(spark, d, "documents").select("doc_id")
    a = v.join(docs, v.vec_id == docs.doc_id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("vectors_without_document").alias("check"), "n")
    b = docs.join(v, v.vec_id == docs.doc_id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("documents_without_vector").alias("check"), "n")
    c = v.agg((F.count("vec_id") - F.count_distinct("vec_id")).alias("n")).select(F.lit("repeated_vectors").alias("check"), "n")
    e = v.where(F.size("embedding") != 64).agg(F.count("*").alias("n")).select(F.lit("wrong_dimension").alias("check"), "n")
    return a.union(b).union(c).union(e)


@query
def metric_distribution(spark, d):
    long = cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)).unpivot(["l1"], METRICS, "metric", "value")
    q = F.percentile("value", F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99))))
    out = long.groupBy("metric").agg(F.count("value").alias("n"), F.count_distinct("value").alias("n_unique"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"), skew("value").alias("skew"))
    iqr = F.col("q")[3] - F.col("q")[1]
    far = long.join(F.broadcast(out.select("metric", (F.col("q")[1] - 1.5 * iqr).alias("lo"), (F.col("q")[3] + 1.5 * iqr).alias("hi"))), "metric").groupBy("metric").agg(F.avg(((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).cast("double")).alias("outlier_share"))  # a row for each metric
    return rounded(out.join(far, "metric").select("metric", "n", "n_unique", "mean", "std", F.col("q")[0].alias("p01"), F.col("q")[2].alias("median"), F.col("q")[4].alias("p99"), "skew", "outlier_share"), 5)


@query
def metric_correlations(spark, d):
    long = cloud.dispersion(vectors(spark, d), ["l1"], sizes(spark, d)).unpivot(["l1"], METRICS, "metric", "value").where("value is not null")
    a, b = long.select("l1", F.col("metric").alias("a"), F.col("value").alias("x")), long.select("l1", F.col("metric").alias("b"), F.col("value").alias("y"))
    pairs = a.join(b, "l1").where("a < b")
    r = pairs.withColumns({"rx": mean_rank("x", "a", "b"), "ry": mean_rank("y", "a", "b")})
    return rounded(r.groupBy("a", "b").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"), correlation(F.col("rx"), F.col("ry")).alias("spearman")), 5)


@query
def cluster_scores(spark, d):
    s = cluster.silhouettes(vectors(spark, d), "work_id", "l1", "u")
    return rounded(s.groupBy("l1").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette")))


@query
def cluster_composition(spark, d):
    return rounded(cluster.composition(vectors(spark, d).withColumn("part", F.col("year") % 4), "l1", "part"))


@query
def cluster_purity(spark, d):
    return rounded(cluster.purity(vectors(spark, d), "l2", "l1"))


@query
def cluster_relabel(spark, d):
    return cluster.relabelled(vectors(spark, d), "work_id", "l1")


@query
def contingency_ari(spark, d):
    return rounded(cluster.adjusted_rand(vectors(spark, d), "l1", "l2"))


@query
def cluster_assign(spark, d):
    return cluster.assign(cloud.unit_centroids(vectors(spark, d), ["l1"]), "l1", "centroid", 3, "ward")


def grid(spark, d):
    p = vectors(spark, d).select("l1", F.col("u")[0].alias("x"), F.col("u")[1].alias("y"))
    return density.cells(p, ["l1"], "x", "y", -0.5, 0.5, 8)


@query
def density_cells(spark, d):
    return rounded(grid(spark, d))


@query
def density_smoothed(spark, d):
    return rounded(density.smoothed(grid(spark, d), ["l1"], 8, 1.0))


@query
def density_entropy(spark, d):
    return rounded(density.concentration(grid(spark, d), ["l1"], 8))


@query
def events_tumbling(spark, d):
    return rounded(acceptance.tumbling(table(spark, d, "events")), 3)


@query
def events_accept_stream(spark, d):
    """The table of events as a stream: up to three ids of each user and type in order of arrival."""
    kind = table(spark, d, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    return acceptance.finished(acceptance.accepted(events, 3)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))
