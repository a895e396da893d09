"""Shared tables, numpy text kernels and graph components for the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
CHUNK = 1 << 19  # bytes of texts that numpy works on at once
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24  # texts may be long, so a Python worker gets few at a time
BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds what a Python worker gets at once, by rows and by bytes; bounds that are lower stay."""
    conf = "spark.sql.execution.arrow."
    if int(spark.conf.get(conf + "maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set(conf + "maxRecordsPerBatch", BATCH_ROWS)
    held = (spark.conf.get(conf + "maxBytesPerBatch", None) or "").rstrip("b")
    if not (held.isdigit() and 0 < int(held) <= most):
        spark.conf.set(conf + "maxBytesPerBatch", most)


# ---------------------------------------------------------------- tables in the shared folder
class Scratch:
    """Intermediate tables of one run, in the folder that the cluster's spark.checkpoint.dir names.

    A table that is written cuts the lineage: a lost executor costs a re-read and no earlier stage runs again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            root = "file://" + tempfile.mkdtemp(prefix="cloudform-")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(v, comp) for every end of edges(a, b): the smallest vertex that links reach.

    Minimum labels spread along the links and then jump to the label of their label, so chains halve in each
    round. Joins and partial minima only: a vertex with very many links is split like any skewed join.
    """
    both = scratch.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}_links")
    labels = scratch.put(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("comp")), f"{name}_0")
    before, step = None, 0
    while True:
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before, step = total, step + 1
        sent = both.join(labels, both.a == labels.v).select(F.col("b").alias("v"), "comp")
        spread = scratch.put(labels.union(sent).groupBy("v").agg(F.min("comp").alias("comp")), f"{name}_spread")
        up = spread.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        labels = scratch.put(spread.join(up, "comp").select("v", F.col("root").alias("comp")), f"{name}_{step % 2 + 1}")


BITS = 1 << 25
SLOTS = 1 << 24


def fresh(name: str, columns) -> str:
    """A name longer than any of the columns, so it clashes with none."""
    return name + "_" * (1 + max(map(len, columns), default=0))


def bit_words(df: DataFrame, key: F.Column, bits: int) -> DataFrame:
    """word and bits: a set bit at key mod bits for each row, in bits / 64 rows at most whatever the number of rows."""
    slot = df.select(F.pmod(key, F.lit(bits)).alias("slot"))
    return slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))


def bitmap(df: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """The same as bits / 8 bytes on the driver.

    Looking a row up there first spares most rows that an exact join would drop; it never replaces the join.
    """
    rows = bit_words(df, F.col(name), bits).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def sieved(rows: DataFrame, key: F.Column, some: DataFrame, own: F.Column, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the keys `own` of some, rows whose key surely is not); key and own are hashes.

    The bitmap may be broadcast whatever the size of some; where it fills up, more rows may be among them.
    """
    word, held, slot = (fresh(c, rows.columns) for c in ("word", "bits", "slot"))
    seen = rows.withColumn(slot, F.pmod(key, F.lit(bits))).join(F.broadcast(bit_words(some, own, bits).toDF(word, held)), F.expr(f"shiftright(`{slot}`, 6)") == F.col(word), "left")
    may = F.coalesce(F.getbit(held, F.expr(f"cast(`{slot}` & 63 as int)")) == 1, F.lit(False))
    mine = [F.col(f"`{c}`") for c in rows.columns]
    return seen.where(may).select(*mine), seen.where(~may).select(*mine)


def with_value(rows: DataFrame, keys: list[F.Column], known: DataFrame, name: str, slots: int = SLOTS) -> DataFrame:
    """rows with a column `name`, the value that known(k0, k1, ..., v) gives each row's keys; v is 0, 1, 2 or 3.

    known has each key of rows once. Its values go to four bits for each slot of a hash: slots / 16 rows at most
    whatever its size, so they may be broadcast. Where all keys of a slot have one value, that is the row's. Only the
    other rows are shuffled, for an exact join.
    """
    word, held, slot = (fresh(c, [*rows.columns, name]) for c in ("word", "bits", "slot"))
    ks = known.columns[:-1]
    table = known.select(F.pmod(F.xxhash64(*ks), F.lit(slots)).alias(slot), known.columns[-1])
    table = table.groupBy(F.shiftright(slot, 4).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast(({slot} & 15) * 4 + v as int)))").alias(held))
    seen = rows.withColumn(slot, F.pmod(F.xxhash64(*keys), F.lit(slots))).join(F.broadcast(table), F.expr(f"shiftright(`{slot}`, 4)") == F.col(word), "left")
    nibble = F.expr(f"shiftright(`{held}`, cast((`{slot}` & 15) * 4 as int)) & 15")
    value = F.when(nibble == 1, 0).when(nibble == 2, 1).when(nibble == 4, 2).when(nibble == 8, 3)
    mine = [F.col(f"`{c}`") for c in rows.columns]
    sure = seen.where(value.isNotNull()).select(*mine, value.cast("int").alias(name))
    names = [fresh(k, [*rows.columns, name]) for k in known.columns]
    on = [a.eqNullSafe(F.col(b)) for a, b in zip(keys, names, strict=False)]
    open_ = seen.where(value.isNull()).select(*mine).join(known.toDF(*names), on).select(*mine, F.col(names[-1]).cast("int").alias(name))
    return sure.unionByName(open_)


def marked(batch: pa.RecordBatch, name: str, bits: np.ndarray) -> pa.RecordBatch:
    slot = longs(batch, name) % (len(bits) * 8)
    return batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 == 1))


# ---------------------------------------------------------------- bytes of texts
def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and their n + 1 offsets. A null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Ranges [i, j) of texts with about `most` bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches(frames, text: str = "text", most: int = CHUNK):
    """(batch, first row, row after the last, bytes, offsets) over pieces of bounded size of an Arrow stream."""
    for batch in frames:
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        for i, j in chunks(offsets, most):
            yield batch, i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    release()


def release() -> None:
    """Gives back to the system what a worker, which lives on after its task, no longer needs."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ U(seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as have been needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size, b, U)])) for b in (BASE, inverse))
        return self.up, self.down

    def sums(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.upto(len(data))
        out = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not blank, and how many words each text has.

    A run never crosses texts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~blank[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & (~after | last)) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def blob(arrays: list[bytes]) -> pa.Array:
    return pa.array(arrays, pa.binary())
