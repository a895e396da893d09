"""Raw records: identifiers, names, acceptance, request plans and errors, as column expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import token_count


def short_id(url) -> Column:
    """The last segment of a URL; NULL where there is none."""
    return F.nullif(F.regexp_extract(F.trim(url), r"([^/]*)/*$", 1), F.lit(""))


def slug(*parts: Column) -> Column:
    """Lower-case ASCII words joined by underscores; other characters separate."""
    text = F.lower(F.concat_ws("_", *(p.cast("string") for p in parts)))
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", "_"), F.lit("_"))


def first_present(df: DataFrame, canonical: str, *aliases: str) -> Column:
    """A flag from whichever of its names the table has; an error when it has none."""
    have = [c for c in (canonical, *aliases) if c in df.columns]
    if not have:
        raise ValueError(f"none of these columns: {', '.join((canonical, *aliases))}")
    return F.coalesce(*(F.col(c).cast("boolean") for c in have)).alias(canonical)


def acceptance(checks: dict[str, Column]) -> Column:
    """The name of the first check that a row fails, NULL for a row that passes all; an unknown check fails."""
    out = None
    for name, ok in checks.items():
        fails = ~F.coalesce(ok, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def long_enough(title, body, title_least: int = 5, body_least: int = 80) -> tuple[Column, Column]:
    return token_count(title) >= title_least, token_count(body) >= body_least


def error_class(text) -> Column:
    """Coarse class of an error message."""
    t = F.lower(text)
    return (
        F.when(t.isNull() | (F.trim(t) == ""), "none")
        .when(t.rlike(r"\b429\b|rate limit|too many requests"), "rate_limit")
        .when(t.rlike(r"timed? ?out"), "timeout")
        .when(t.rlike(r"\b5\d\d\b|server error"), "server")
        .when(t.rlike("connection|network|resolve"), "network")
        .otherwise("other")
    )


def request_totals(plan: DataFrame, method: str, size: str, page: int = 200) -> DataFrame:
    """Cells, rows and pages that each method asks for."""
    pages = F.ceil(F.col(size) / page)
    return plan.groupBy(method).agg(F.count("*").alias("n_cells"), F.sum(size).alias("n_rows"), F.sum(pages).alias("n_pages"))


def backfill(coverage: DataFrame, keys: list[str], factor: float, round_: int, seed: int) -> DataFrame:
    """What the next round asks of cells that fell short: half more than oversampling gives, with a seed of its own."""
    ask = F.ceil(F.col("shortfall") * factor * 1.5).cast("long")
    own = F.pmod(F.xxhash64(F.lit(seed), F.lit(round_), *keys), F.lit(2**31)).cast("long")
    return coverage.where("shortfall > 0").select(*keys, "shortfall", ask.alias("request"), own.alias("seed"))


def names_by_id(rows: DataFrame, id_: str, name: str) -> DataFrame:
    """Each id once, with its first name in order and the number of names it bears."""
    return rows.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.min(name).alias(name), F.count_distinct(name).alias("n_names"))


def completion(expected: DataFrame, actual: DataFrame, keys: list[str], enough: float = 0.99) -> DataFrame:
    """One row: cells expected and present, their share, and a verdict."""
    out = expected.select(*keys).distinct().join(actual.select(*keys, F.lit(1).alias("here")).distinct(), keys, "left")
    n = out.agg(F.count("*").alias("expected"), F.count("here").alias("actual"))
    part = F.when(F.col("expected") > 0, F.col("actual") / F.col("expected")).otherwise(0.0)
    return n.select("*", part.alias("share"), F.when(part >= enough, "complete").otherwise("incomplete").alias("verdict"))


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: keys in both tables whose values differ, NULL against NULL being equal."""
    both = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns)), key)
    row = both.agg(*(F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns))
    return row.unpivot([], columns, "column", "n")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Size of the intersection of two key sets and its share of the smaller."""
    x, y = a.select(key, F.lit(1).alias("x")).distinct(), b.select(key, F.lit(1).alias("y")).distinct()
    n = x.join(y, key, "full").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("n_both"))
    least = F.least("n_a", "n_b")
    return n.select("*", F.when(least > 0, F.col("n_both") / least).alias("overlap"))


def union_new(base: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Base and new rows with each key once, the base's row first."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_new", *order)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")
