"""Tables of entities and their rows: references, flags, selections, validated joins, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..functions.vec import euclid
from ..sources.files import require
from ..sources.scratch import written
from .records import short_id

COMPLETED = ("completed", "completed_with_warnings")


# ---------------------------------------------------------------- columns
def entity_ref(entity, id_: str = "id", name: str = "display_name") -> Column:
    """(id, name) of a nested entity: the last segment of its URL, and its name."""
    e = F.col(entity) if isinstance(entity, str) else entity
    return F.when(e.isNotNull(), F.struct(short_id(e[id_]).alias("id"), e[name].alias("name")))


def resolved_flags(df: DataFrame, generations: list[dict[str, str]], needed: tuple[str, ...], aliases: dict[str, str]) -> DataFrame:
    """df with canonical boolean flags from the first generation of names that it has in full, and aliases of them.

    A generation maps canonical flags to columns. Flags that a generation lacks are NULL; an error when none has the
    needed ones.
    """
    for names in generations:
        if all(names.get(f) in df.columns for f in needed):
            flags = {f for g in generations for f in g}
            made = {f: (F.col(names[f]).try_cast("boolean") if names.get(f) in df.columns else F.lit(None).cast("boolean")) for f in sorted(flags)}
            out = df.withColumns(made)
            return out.withColumns({alias: F.col(f) for alias, f in aliases.items()})
    missing = "; ".join(", ".join(g.get(f, f) for f in needed if g.get(f) not in df.columns) for g in generations)
    raise ValueError(f"no generation of flags is whole; missing: {missing}")


def with_absent(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns that older files lack, by their rules; NULLs of present columns stay."""
    return df.withColumns({c: x for c, x in defaults.items() if c not in df.columns})


def reduced(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Keys and metrics as numbers; what is no number becomes NULL, and so do NaN and infinity."""
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    return require(df, *keys, *metrics).select(*keys, *(F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c)).alias(c) for c in metrics))


def split_columns(df: DataFrame, keys: list[str], metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables with the same keys: what describes the rows, and the metrics."""
    return df.select(*keys, *(c for c in df.columns if c not in (*keys, *metrics))), df.select(*keys, *(c for c in metrics if c in df.columns))


def strict_metrics(df: DataFrame, id_: str, metrics: list[str], status: str | None = "status") -> DataFrame:
    """Completed rows with all metrics as numbers; an error if any is missing."""
    rows = completed(df, status) if status else df
    out = reduced(rows, [id_], metrics)
    bad = out.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in metrics)).first().asDict()  # one row
    if any(bad.values()):
        raise ValueError("missing values: " + ", ".join(f"{c} in {n} rows" for c, n in bad.items() if n))
    return out


# ---------------------------------------------------------------- rows
def completed(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows that are completed, with or without warnings; all rows of a table without a status."""
    return df.where(F.col(status).isin(*COMPLETED)) if status in df.columns else df


def not_completed(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(~F.coalesce(F.col(status).isin(*COMPLETED), F.lit(False)))


def in_years(df: DataFrame, flag: str, first: int, last: int) -> DataFrame:
    """Rows whose flag holds, in a range of years."""
    return df.where(F.coalesce(F.col(flag), F.lit(False)) & F.col("year").between(first, last))


def numbered(df: DataFrame, order: list[str], id_: str, name: str = "row_id") -> DataFrame:
    """df with a number from 0 without a gap, in a total order; an error where an id repeats.

    The keys alone are dealt over ranges of the order, once: the ranges' bounds are sampled, so a second scan might cut
    elsewhere. What is written then is numbered from the sizes of the ranges before, and df finds its numbers by id.
    """
    if df.groupBy(id_).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {id_}")
    order = [c for c in order if c != id_]
    own = df.select(*order, id_).repartitionByRange(*order, id_).sortWithinPartitions(*order, id_)
    own = written(own.select(F.col(id_).alias("_id"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # a row for each range
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = own.join(F.broadcast(start), "_p").select("_id", (F.col("_start") + F.col("_m") - F.col("_first")).alias(name))
    return df.join(number, df[id_].eqNullSafe(number["_id"])).drop("_id")


def chosen(df: DataFrame, id_: str, *, only: list | None = None, first: int | None = None) -> DataFrame:
    """Rows of some entities: those of a list, or the first ones by id; an error if a listed one has no rows."""
    if only is not None:
        have = {r[0] for r in df.where(F.col(id_).isin(only)).select(id_).distinct().collect()}  # of a list
        if missing := [i for i in only if i not in have]:
            raise ValueError(f"no rows of {missing}")
        return df.where(F.col(id_).isin(only))
    if first is None:
        return df
    return df.join(F.broadcast(df.select(id_).distinct().orderBy(id_).limit(first)), id_, "left_semi")  # of a given size


def shared_names(df: DataFrame, id_: str, name: str) -> DataFrame:
    """The ids of names that several ids bear."""
    rows = df.select(id_, name).distinct()
    many = rows.groupBy(name).agg(F.count("*").alias("n_ids")).where("n_ids > 1")
    return rows.join(many, name).select(name, id_, "n_ids")


def threshold_list(diagnostics: DataFrame, column: str, least: float) -> DataFrame:
    """The metrics whose diagnostic reaches a threshold, strongest first."""
    out = diagnostics.where(F.col(column) >= least).select("metric", column)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col(column).desc(), "metric")))  # a row for each metric


# ---------------------------------------------------------------- joins
def from_parent(child: DataFrame, parent: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """child with its own columns, filled from the parent's where they are NULL or blank."""
    p = parent.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    own = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).cast(child.schema[c].dataType) if c in child.columns else F.lit(None)
    out = child.join(p, key, "left")
    return out.select(key, *(F.col(c) for c in child.columns if c not in (key, *columns)), *(F.coalesce(own(c), F.col(f"_p_{c}")).alias(c) for c in columns))


def many_to_one(left: DataFrame, right: DataFrame, key: str, *, all_match: bool = False) -> DataFrame:
    """left with the columns of right; an error where right repeats a key or, if all must match, where a row finds none."""
    if right.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats on the right")
    if all_match and (n := left.join(right, key, "left_anti").count()):
        raise ValueError(f"{n} rows without a match by {key}")
    return left.join(right, key, "left")


def both_sides(pairs: DataFrame, drivers: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """pairs(a, b, ...) with the columns of drivers for each end, and the stronger end of the first of them."""
    side = lambda s: drivers.select(F.col(entity).cast("string").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    x, y = F.col(f"{columns[0]}_a"), F.col(f"{columns[0]}_b")
    return out.withColumn("driver", F.when(x.isNull() | y.isNull(), "unavailable").when(x > y, F.col("a")).when(y > x, F.col("b")).otherwise("both"))


def full_plan(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of totals by the same keys in a full outer join, zero where a table lacks a key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out.na.fill(0, [c for c in out.columns if c not in keys])


def by_year(counts: DataFrame, keys: list[str], value: str, years: range) -> DataFrame:
    """A column for each year of a range, zero where there is none."""
    return counts.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("year") == y, F.col(value))), F.lit(0)).alias(f"{value}_{y}") for y in years))


def master_table(base: DataFrame, id_: str, parts: dict[str, DataFrame]) -> DataFrame:
    """base with the columns of all parts by id, each under its part's name."""
    for name, p in parts.items():
        base = base.join(p.select(id_, *(F.col(c).alias(f"{name}_{c}") for c in p.columns if c != id_)), id_, "left")
    return base


# ---------------------------------------------------------------- clusters
def representatives(points: DataFrame, id_: str, cluster: str, vector: str, n: int = 5) -> DataFrame:
    """The n points nearest to the mean of each cluster."""
    from ..functions.vec import centroids

    d = points.select(id_, cluster, vector).join(centroids(points, [cluster], vector), cluster).select(id_, cluster, euclid(vector, "centroid").alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy("d", id_))).where(F.col("rank") <= n)


def outliers(rows: DataFrame, spec: str, id_: str, value: str, n: int) -> DataFrame:
    """The n rows of the largest value of each spec."""
    w = Window.partitionBy(spec).orderBy(F.col(value).desc_nulls_last(), id_)
    return rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= n) & F.col(value).isNotNull())


def top_by(rows: DataFrame, keys: list[str], order: Column, ties: list[str], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))).where(F.col("rank") <= n)


def cluster_report(points: DataFrame, id_: str, cluster: str, domain: str, margins: DataFrame, n: int = 3) -> DataFrame:
    """A row for each cluster: size, the mix of domains as text, prototypes, median margin and share of border points."""
    mix = points.groupBy(cluster, domain).agg(F.count("*").alias("n")).withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))
    item = F.concat(F.col(domain).cast("string"), F.lit(" "), F.round(100 * F.col("part")).cast("long"), F.lit("%"))
    texts = mix.groupBy(cluster).agg(F.sum("n").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(domain).cast("string").alias("d"), item.alias("t")))), lambda x: x.t), ", ").alias("mix"))
    near = top_by(margins, [cluster], F.col("own").asc(), [id_], n)
    protos = near.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(id_).cast("string").alias("i")))), lambda x: x.i), ", ").alias("prototypes"))
    edge = margins.groupBy(cluster).agg(F.median("margin").alias("median_margin"), F.avg((F.col("margin") < 0).cast("double")).alias("border_share"))
    return texts.join(protos, cluster, "left").join(edge, cluster, "left")


def deviations(long: DataFrame, cluster: str, n: int) -> DataFrame:
    """The n metrics of each cluster whose mean of scaled values is farthest from zero, as text."""
    mean = long.groupBy(cluster, "metric").agg(F.avg("scaled").alias("m")).where("m is not null")
    top = top_by(mean, [cluster], F.abs("m").desc(), ["metric"], n)
    item = F.concat("metric", F.lit(" "), F.format_string("%+.2f", "m"))
    return top.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))), lambda x: x.t), "; ").alias("deviations"))


def preferred(models: DataFrame, k: int) -> DataFrame:
    """The model whose number of clusters is nearest to k, then the better score."""
    return models.orderBy(F.abs(F.col("k") - k), F.col("silhouette").desc_nulls_last(), "k", "method").limit(1)


def strongest_correlations(pairs: DataFrame, value: str, n: int) -> DataFrame:
    """The n pairs of metrics with the largest absolute correlation."""
    out = pairs.where(F.col(value).isNotNull())
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(value).desc(), "a", "b"))).where(F.col("rank") <= n)  # pairs of metrics


def distribution_flags(distribution: DataFrame, few: int = 3, skewed: float = 2.0, missing: float = 0.3) -> DataFrame:
    """Which metrics hardly vary, are skewed or mostly miss."""
    f = {"near_constant": F.col("n_unique") <= few, "skewed": F.coalesce(F.abs("skew") >= skewed, F.lit(False)), "missing": F.col("missing_share") >= missing}
    out = distribution.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in f.items()})
    return out.withColumn("flags", F.array_join(F.filter(F.array(*(F.when(F.col(k), k) for k in f)), lambda x: x.isNotNull()), ","))


def level_columns(level: str, levels: dict[str, tuple[str, str]]) -> tuple[str, str]:
    """The id and name columns of a level; an error for an unknown one."""
    if level not in levels:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(levels)}")
    return levels[level]


def size_list(text) -> Column:
    """Numbers of a text such as `11;40;44`."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias(value))
