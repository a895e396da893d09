"""Arrays of shards, read in ranges of bytes and written shard by shard, and the job that embeds texts into them.

Files are opened inside tasks by pyarrow's file systems, so any address that pyarrow knows will do (a local path, file:,
hdfs:, s3:, gs:). A header is read from the first bytes alone; bodies are never loaded whole.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shards import PATTERN, npy_header, shard_files, shards_to_do

HEAD = 1024  # bytes that are read for a header
PIECE = 8 << 20  # bytes of an array that a task turns into rows at once


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def header(path: str, most: int = HEAD) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and place of the first number of a .npy file; reads at most `most` bytes."""
    fs, p = located(path)
    with fs.open_input_file(p) as f:
        kind, shape, start = npy_header(f.read(most))
    return np.dtype(kind), shape, start


def rows_between(path: str, kind: np.dtype, dim: int, start: int, low: int, high: int, piece: int = PIECE):
    """(first row, matrix) of pieces of the rows low to high of an array, from those rows' bytes alone."""
    fs, p = located(path)
    wide = kind.itemsize * dim
    step = max(1, piece // max(wide, 1))
    with fs.open_input_file(p) as f:
        for a in range(low, high, step):
            b = min(a + step, high)
            body = f.read_at((b - a) * wide, start + a * wide)
            if len(body) != (b - a) * wide:
                raise ValueError(f"the array ends before row {b}: {path}")
            yield a, np.frombuffer(body, kind).reshape(b - a, dim)


class Part(InputPartition):
    def __init__(self, path, shard, kind, dim, start, low, high):
        self.path, self.shard, self.kind, self.dim, self.start, self.low, self.high = path, shard, kind, dim, start, low, high


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.size = json.loads(options["files"]), int(options["size"])

    def partitions(self):
        out = []
        for path, shard, kind, n, dim, start in self.files:
            step = max(1, self.size // max(np.dtype(kind).itemsize * dim, 1))
            out += [Part(path, shard, kind, dim, start, a, min(a + step, n)) for a in range(0, n, step)]
        return out or [Part("", 0, "<f4", 1, 0, 0, 0)]

    def read(self, partition):
        if partition.low == partition.high:
            return
        for a, m in rows_between(partition.path, np.dtype(partition.kind), partition.dim, partition.start, partition.low, partition.high):
            n = len(m)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.dim), pa.array(m.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.shard, np.int32)), pa.array(np.arange(a, a + n)), vectors], ["shard", "row", "embedding"])


class ArraySource(DataSource):
    """Options: files (a JSON list of path, shard, type, rows, dimension and start of each array), size (bytes of a task).

    A task that is lost reads its own rows again.
    """

    @classmethod
    def name(cls):
        return "npy_rows"

    def schema(self):
        return "shard int, row long, embedding array<float>"

    def reader(self, schema):
        return ArrayReader(self.options)


def array_headers(spark: SparkSession, folder: str, most: int = HEAD) -> DataFrame:
    """path, shard, dtype and its code, n_rows, dim and start of every array of a folder; tasks read the first bytes of the files."""

    def run(frames):
        for batch in frames:
            out = []
            for path in batch.column(0).to_pylist():
                kind, shape, start = header(path, most)
                out.append({"path": path, "dtype": kind.name, "code": kind.str, "n_rows": int(shape[0]), "dim": int(shape[1]) if len(shape) > 1 else 1, "start": start})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("dtype", pa.string()), ("code", pa.string()), ("n_rows", pa.int64()), ("dim", pa.int32()), ("start", pa.int64())]))

    files = shard_files(spark, folder).where(F.col("kind") == "embeddings").where(F.col("path").endswith(".npy")).select("path")
    heads = files.mapInArrow(run, "path string, dtype string, code string, n_rows long, dim int, start long")
    return heads.withColumn("shard", F.regexp_extract("path", PATTERN, 1).cast("int"))


def read_arrays(spark: SparkSession, folder: str, *, size: int = 128 << 20) -> DataFrame:
    """shard, row and embedding (single precision) of every shard_NNNN_embeddings.npy; a task reads about `size` bytes of one file.

    A folder without arrays has no rows. The driver holds a row for each file.
    """
    heads = [[r.path, r.shard, r.code, r.n_rows, r.dim, r.start] for r in array_headers(spark, folder).orderBy("path").collect()]
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy_rows").options(files=json.dumps(heads), size=str(size)).load()


# ---------------------------------------------------------------- writing
def _put(folder: str, name: str, body: bytes) -> None:
    """A file that is there whole or not at all: written under a name of its own, then moved."""
    fs, p = located(folder)
    fs.create_dir(p, recursive=True)
    own = f"{p}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(body)
    fs.move(own, f"{p}/{name}")


def planned_shards(rows: DataFrame, id_: str, size: int) -> DataFrame:
    """rows with a shard by a hash of the id, so that shards hold about `size` rows each."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("shard", F.pmod(F.xxhash64(id_), F.lit(n)).cast("int"))


def write_shards(rows: DataFrame, folder: str, id_: str, vector: str, *, dtype: str = "float32", summary: dict | None = None) -> DataFrame:
    """(shard, n_rows, dim) of what is written: for each shard of rows(shard, id, vector, ...) an array, metadata and a summary.

    Rows are ordered by id; metadata holds every column but the vector, and `row`, the row's place in the array. A shard is
    one task, so its size must be planned (`planned_shards`). Metadata and summary come before the array, whose presence
    thus says that the shard is whole; a task that runs twice writes the same files. NULL vectors and vectors of several
    lengths in a shard are errors.
    """
    rest = [c for c in rows.columns if c not in (vector, "row")]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([(id_, "ascending")])
        lists = t.column(vector).combine_chunks()
        dims = set(lists.value_lengths().to_pylist())
        if len(dims) != 1 or None in dims or lists.flatten().null_count:
            raise ValueError(f"vectors of shard {key[0]} are missing or differ in length")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(lists), -1)
        name, n = f"shard_{key[0].as_py():04d}", len(x)
        out = io.BytesIO()
        pq.write_table(t.select(rest).append_column("row", pa.array(np.arange(n, dtype=np.int32))), out)
        _put(folder, f"{name}_metadata.parquet", out.getvalue())
        _put(folder, f"{name}_summary.json", json.dumps((summary or {}) | {"n_rows": n, "dim": x.shape[1], "dtype": dtype}, sort_keys=True).encode())
        out = io.BytesIO()
        np.save(out, x)
        _put(folder, f"{name}_embeddings.npy", out.getvalue())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_rows": [n], "dim": pa.array([x.shape[1]], pa.int32())})

    return rows.groupBy("shard").applyInArrow(run, "shard int, n_rows long, dim int")


def joined_text(title: Column, abstract: Column, separator: str) -> Column:
    """Title, separator and abstract; a missing part is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(separator), F.coalesce(abstract, F.lit("")))


def embed_shards(rows: DataFrame, folder: str, id_: str, text: str, make_predict: Callable[[], Callable], *, batch: int = 32, dtype: str = "float16", summary: dict | None = None) -> DataFrame:
    """Embeds the text of rows(shard, id, text, ...) into the shards that the folder lacks; (shard, n_rows, dim) of those done now.

    make_predict loads the model once in each worker and gives a function from an array of texts to a matrix. Texts are
    not written. Shards whose array and metadata are there are left alone, so a broken run is taken up where it stopped.
    """
    fs, p = located(folder)
    fs.create_dir(p, recursive=True)
    files = shard_files(rows.sparkSession, folder)
    todo = shards_to_do(rows, files).repartition("shard")
    model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    done = todo.withColumn("_vector", model(F.coalesce(text, F.lit("")))).drop(text)
    return write_shards(done, folder, id_, "_vector", dtype=dtype, summary=summary)
