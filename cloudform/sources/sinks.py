"""Sinks: replaced tables, summaries as JSON and Markdown, checkpoints of a growing table, and manifests of runs."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import table_name

STATUS = ("completed", "completed_with_warnings", "partial", "skipped", "failed")


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as a table of the catalogue in place of one of that name; the name must be plain."""
    w = df.write.mode("overwrite").format("parquet")
    (w.option("path", path) if path else w).saveAsTable(table_name(name))
    return df.sparkSession.table(name)


def json_safe(value):
    """A value as JSON can hold it: NaN and infinity become null, keys become text, dates their ISO form."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "item"):
        return json_safe(value.item())
    return value


def _write(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, payload) -> None:
    """A summary as JSON at any path that Spark can reach."""
    _write(spark, path, json.dumps(json_safe(payload), indent=2, ensure_ascii=False, sort_keys=True) + "\n")


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows of a report as a Markdown table; `most` is the size of the report."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(v) for v in r] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str, most: int = 100) -> None:
    _write(df.sparkSession, path, f"# {title}\n\n{markdown_table(df, most)}")


def checkpointed(base: DataFrame, new: DataFrame, key: str, entity: str, order: list[str], cap: int) -> DataFrame:
    """Base and new rows, each key once with the base's row first, at most `cap` rows of each entity."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    once = both.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_new", *order))).where("_k = 1")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy("_new", *order, key))).where(F.col("_k") <= cap).drop("_k", "_new")


def manifest(groups: DataFrame, group: str, status: Column, *, run: dict[str, str], error: Column | None = None) -> DataFrame:
    """A row for each group: status, what the run was given, and the error; an unknown status becomes failed."""
    known = F.when(status.isin(*STATUS), status).otherwise("failed")
    return groups.select(group, "n_available", "n_used", known.alias("status"), *(F.lit(v).alias(k) for k, v in run.items()), F.coalesce(error if error is not None else F.lit(None), F.lit("")).alias("error"))
