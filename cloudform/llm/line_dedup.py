"""Line dedup: lines that many documents share stay in one of them only. DataFrame operations alone.

Normalised lines are exploded and hashed (MD5), documents are counted by hash, and lines of hashes over the threshold go,
except in the document of the largest id that holds the line. Only hashes, ids and positions are shuffled to decide; a
text travels once, and only where it loses lines. A bitmap of fixed size spares the exact join the lines that surely
stay. A hash with over 1/1024 of all candidate lines is looked up by broadcast, so no task gathers a very common line:
there are at most 1024 of those.

A null or empty text is one empty line. Each row is a document of its own, also where rows repeat an id; a null id is
smaller than all others. Rows of the largest id that holds a line all keep it. Columns named n_lines, n_dropped or kept
give way to the results; all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import BITS, Scratch, fresh, sieved
from .license_scan import SMALL, UPPER

BLANK = " \t\n\x0b\x0c\r"
HEAVY = 1024  # a hash with more than this part of the candidate lines is joined by broadcast
MADE = ("n_lines", "n_dropped", "kept")


def line_keys(text: F.Column) -> F.Column:
    """The normalised lines of a text: without blanks at both ends, A-Z in lower case."""
    bare = F.transform(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANK)))
    return F.transform(bare, lambda line: F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, SMALL)))


def row_of(id_: str = "doc_id") -> tuple[F.Column, F.Column]:
    """What tells rows apart: the id and a hash of the text. Rows alike in both have the same fate."""
    return F.col(id_).alias("id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("twin")


def line_dedup(docs: DataFrame, *, least: int = 20, documents: int = 3, bits: int = BITS) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the text without lines that other documents keep.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least `least` code points
    that stand in at least `documents` rows lose their lines except in the largest doc_id holding them.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop(*MADE)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.transform(line_keys(text), lambda k: F.when(F.length(k) >= least, F.unhex(F.md5(k.cast("binary")))))
    lines = docs.select(*row_of(), hashed.alias("keys"))

    held = lines.select("id", F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL")
    common = held.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= documents)
    common = scratch.put(common, "common")
    total = common.agg(F.sum("n")).first()[0] or 0

    spots = lines.select("id", "twin", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
    may, _ = sieved(spots, F.xxhash64("key"), common, F.xxhash64("key"), bits)
    may = scratch.put(may, "spots")
    heavy = F.broadcast(common.where(F.col("n") * HEAVY > total).select("key", F.struct("last").alias("top")))
    seen = may.join(heavy, "key", "left")
    rest = common.where(F.col("n") * HEAVY <= total).select("key", "last")
    ends = seen.where("top IS NOT NULL").select("id", "twin", "at", "top.last").unionByName(seen.where("top IS NULL").drop("top").join(rest, "key").select("id", "twin", "at", "last"))
    gone = ends.where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "twin").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    gone = scratch.put(gone, "gone")

    id_, twin, lost, split = (fresh(c, docs.columns) for c in ("id", "twin", "gone", "lines"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    mine = docs.select(*own, *(k.alias(n) for k, n in zip(row_of(), (id_, twin), strict=True)))
    some, none = sieved(mine, F.xxhash64(id_, twin), gone, F.xxhash64("id", "twin"), bits)
    whole = lambda df: df.select(*own, F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept"))
    names = gone.toDF(f"{id_}_", f"{twin}_", lost)
    on = F.col(id_).eqNullSafe(F.col(f"{id_}_")) & (F.col(twin) == F.col(f"{twin}_"))
    open_ = some.withColumn(split, F.split(text, "\n", -1)).join(names, on, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce(F.col(lost), F.array().cast("array<int>")))
    cut = open_.select(
        *own, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n").alias("kept"))
    return whole(none).unionByName(cut)
