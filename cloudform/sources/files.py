"""Tables in files: scans with fallback, and guards against overwriting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z0-9_]+")


def table_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated keys: {', '.join(keys)}")
    return df


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet, CSV or JSON by suffix, only the wanted columns that exist."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".csv"):
        df = reader.option("header", True).csv(path)
    elif path.endswith((".json", ".jsonl")):
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def table_or_empty(spark: SparkSession, name: str, path: str, schema: T.StructType) -> DataFrame:
    """The catalogue's table, else the file, else no rows."""
    if spark.catalog.tableExists(table_name(name)):
        return spark.table(name)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, *, overwrite: bool = False, by: list[str] | None = None) -> None:
    """Refuses to overwrite unless told to."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def safe_url(url: str) -> str:
    """The URL with keys and mail addresses hidden."""
    return re.sub(r"(?i)([?&](?:api_key|mailto|key|token)=)[^&#]*", r"\1***", url)
