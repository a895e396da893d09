"""Shards of embedded rows: numpy arrays with metadata tables, their checks, and the aligned table of vectors."""

from __future__ import annotations

import ast
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("embeddings", "metadata", "summary")
PATTERN = r"shard_(\d+)_([a-z]+)\."


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, shard, kind and length of the files of all shards; file bodies are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard_*").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_extract(name, PATTERN, 1).cast("int").alias("shard"), F.regexp_extract(name, PATTERN, 2).alias("kind"), "length").where("shard is not null")


def npy_header(head: bytes) -> tuple[str, tuple[int, ...], int]:
    """dtype, shape and length of the header of a .npy file from its first bytes."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    long = head[6] > 1
    size = struct.unpack("<I", head[8:12])[0] if long else struct.unpack("<H", head[8:10])[0]
    start = 12 if long else 10
    if len(head) < start + size:
        raise ValueError(f"the header has {start + size} bytes")
    info = ast.literal_eval(head[start : start + size].decode("latin1").strip())
    if info["fortran_order"] and len(info["shape"]) > 1:
        raise ValueError("columns stand before rows")
    return info["descr"], info["shape"], start + size


def shard_shapes(spark: SparkSession, folder: str, most: int = 1024) -> DataFrame:
    """shard, dtype, n_rows and dim of every array, from the first bytes of the files."""
    from .arrays import array_headers

    return array_headers(spark, folder, most).select("shard", "dtype", "n_rows", "dim")


def metadata_index(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The metadata of all shards with the shard of each row; schema holds `row`, the row's place, which is written with it."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "shard_*_metadata.parquet").parquet(folder)
    return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_name"), PATTERN, 1).cast("int"))


def aligned(index: DataFrame, vectors: DataFrame, order: list[str]) -> DataFrame:
    """The vector of each row of an index(shard, row, ...), in ranges of a total order; an error if a row has none."""
    v = vectors.select("shard", "row", "embedding")
    if index.join(v, ["shard", "row"], "left_anti").limit(1).count():
        raise ValueError("rows of the index without a vector")
    return index.join(v, ["shard", "row"]).repartitionByRange(*order).sortWithinPartitions(*order)


def out_of_bounds(index: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows of an index(shard, row) whose place is not in the shard's array."""
    j = index.join(shapes.select("shard", "n_rows"), "shard", "left")
    return j.where(F.col("n_rows").isNull() | (F.col("row") < 0) | (F.col("row") >= F.col("n_rows"))).drop("n_rows")


def shard_errors(files: DataFrame, shapes: DataFrame, metadata: DataFrame, *, expected: int | None, dim: int, dtype: str, total: int | None = None) -> DataFrame:
    """(shard, error) for what is wrong with shards: kinds that miss, dimension, type, and numbers of rows that differ."""
    kinds = files.groupBy("shard").agg(F.collect_set("kind").alias("have"))
    missing = kinds.select("shard", F.explode(F.array_except(F.array(*map(F.lit, KINDS[:2])), "have")).alias("k")).select("shard", F.concat(F.lit("no "), "k").alias("error"))
    n = metadata.groupBy("shard").agg(F.count("*").alias("n_meta"))
    j = shapes.join(n, "shard", "full").na.fill(0, ["n_meta"])
    wrong = F.filter(F.array(
        F.when(F.col("dim") != dim, F.format_string(f"dimension %d, not {dim}", "dim")), F.when(F.col("dtype") != dtype, F.concat(F.lit("type "), "dtype", F.lit(f", not {dtype}"))),
        F.when(F.col("n_rows") != F.col("n_meta"), F.format_string("%d vectors, %d rows of metadata", "n_rows", "n_meta"))), lambda x: x.isNotNull())
    out = missing.union(j.select("shard", F.explode(wrong).alias("error")))
    one = shapes.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"))
    none = F.lit(None).cast("int").alias("shard")
    if expected is not None:
        out = out.union(one.where(F.col("n") != expected).select(none, F.format_string(f"%d shards, not {expected}", "n")))
    if total is not None:
        out = out.union(one.where(F.col("rows") != total).select(none, F.format_string(f"%d vectors in all, not {total}", "rows")))
    return out


def shards_to_do(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Shards of a plan(shard, ...) that lack one of the kinds of files."""
    done = files.where(F.col("kind").isin(*KINDS[:2]) & (F.col("length") > 0)).groupBy("shard").agg(F.count_distinct("kind").alias("n")).where(F.col("n") == 2)
    return plan.join(done, "shard", "left_anti")
