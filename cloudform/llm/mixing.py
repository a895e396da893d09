"""Mixing sources to target weights by pivotal dependent rounding on a distributed reduction tree.

A source's target is its share by weight of all words, at most `most` times its own words; what is above is shared
again by weight. Each document then has the same expected number of copies in its source, target / size: a whole part
and a probability. Pairs of documents pass probability to each other, in words, until one of the two is whole; that
keeps each document's expectation and the source's sum of words. Documents go in groups of fixed size, each group hands
on at most one document that is not whole, and these meet in groups again, up to one for each source.

Null texts have no words. A null source is a source of its own, the last one. Rows that repeat id, text and source are one
document in the draw, whose copies are dealt evenly over its rows; so are null ids. Other columns are ignored, whatever
their names. An empty table gives no rows.
Random numbers come from a seed, the source, the level and the group, so a rerun draws the same whatever the cluster.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch, batches, column, words

GROUP = 4096
FAN = 64


def word_counts(frames):
    for batch, i, j, data, offsets in batches(frames):
        some = batch.slice(i, j - i)
        yield pa.RecordBatch.from_pydict({"doc_id": column(some, "doc_id"), "source": column(some, "source"), "twin": column(some, "twin"), "size": pa.array(words(data, offsets)[2], pa.int64())})


def shares(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Parts of sum(sizes) by weight, none above most * its size; the sources that stop first come first."""
    left, open_, out = float(sum(sizes)), sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(float(most * sizes[i]), weights[i] * left / open_)
        left, open_ = left - out[i], open_ - weights[i]
    return out


def rounded(sizes, chances, draw) -> tuple[np.ndarray, int]:
    """0 or 1 for each, but for one that may be left between; and the place of that one, or -1."""
    out = np.array(chances, float)
    held = -1
    for j, (size, p) in enumerate(zip(sizes, chances, strict=True)):
        if not 0 < p < 1:
            continue
        if held < 0:
            held = j
            continue
        q, other = out[held], sizes[held]
        up, down = min((1 - q) * other, p * size), min(q * other, (1 - p) * size)
        if draw.random() * (up + down) < down:
            first = (1 - q) * other <= p * size
            q, p = (1.0 if first else q + up / other), (p - up / size if first else 0.0)
        else:
            first = q * other <= (1 - p) * size
            q, p = (0.0 if first else q - down / other), (p + down / size if first else 1.0)
        out[held], out[j] = q, p
        held = held if 0 < q < 1 else j if 0 < p < 1 else -1
    return out, held


def seeded(seed: int, *key) -> random.Random:
    return random.Random(hashlib.sha256(repr((seed, *key)).encode()).digest())


def leaves(seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("twin", "ascending")])
        sizes, chance = group.column("size").to_pylist(), group.column("chance").to_pylist()
        draw = seeded(seed, group.column("rank")[0].as_py(), 0, group.column("bucket")[0].as_py())
        out, held = rounded(sizes, chance, draw)
        open_ = np.zeros(len(out), bool)
        if held >= 0:
            open_[held] = True
        for name, values in (("chance", out), ("open", open_)):
            group = group.drop_columns([name]) if name in group.column_names else group
            group = group.append_column(name, pa.array(values))
        return group.select(["rank", "bucket", "doc_id", "twin", "size", "rows", "copies", "chance", "open"])

    return run


def branches(seed: int, level: int, last: bool):
    """Of one group of open documents: what each becomes; at the top the last one is drawn."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("bucket", "ascending")])
        draw = seeded(seed, group.column("rank")[0].as_py(), level, group.column("up")[0].as_py())
        out, held = rounded(group.column("size").to_pylist(), group.column("chance").to_pylist(), draw)
        if held >= 0 and last:
            out[held], held = float(draw.random() < out[held]), -1
        open_ = np.zeros(len(out), bool)
        if held >= 0:
            open_[held] = True
        return group.select(["rank", "bucket", "size"]).append_column("chance", pa.array(out)).append_column("open", pa.array(open_))

    return run


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 20) -> DataFrame:
    """doc_id, twin (hash of the text), source, size, source_size, target and copies of each row of docs(doc_id, text, source).

    The sources' totals, a row for each source, are worked out on the driver; weights go round over the sources by
    code point, null last.
    """
    s = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.xxhash64("text").alias("twin"))
    sized = s.put(rows.mapInArrow(word_counts, "doc_id long, source string, twin long, size long"), "sized")
    totals = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    weigh = [float(weights[i % len(weights)]) for i in range(len(totals))]
    target = shares([r["size"] for r in totals], weigh, most)
    plan = [(r.source, i, r["size"], t, min(most, t / r["size"]) if r["size"] else 0.0, max(1, -(-r.n // GROUP))) for i, (r, t) in enumerate(zip(totals, target, strict=True))]
    plan = docs.sparkSession.createDataFrame(plan, "source string, rank int, source_size long, target double, rate double, groups long")
    rate = F.floor("rate").cast("long")
    alike = sized.groupBy("doc_id", "source", "twin", "size").agg(F.count("*").alias("rows"))
    known = alike.join(plan, alike.source.eqNullSafe(plan.source)).drop(plan.source)
    known = known.withColumn("rate", F.col("rate") * F.col("rows"))
    known = known.withColumns({"copies": rate, "chance": F.when(F.col("size") > 0, F.col("rate") - rate).otherwise(0.0), "bucket": F.pmod(F.xxhash64("doc_id", "twin"), "groups")})
    grouped = known.groupBy("rank", "bucket").applyInArrow(leaves(seed), "rank int, bucket long, doc_id long, twin long, size long, rows long, copies long, chance double, open boolean")
    grouped = s.put(grouped, "leaves")
    level, width, now = 1, max([p for p in (-(-r.n // GROUP) for r in totals)], default=1), s.put(grouped.where("open").select("rank", "bucket", "size", "chance", "open"), "open_0")
    settled = None
    while True:
        width = -(-width // FAN)
        step = now.withColumn("up", F.expr(f"bucket div {FAN ** level}")).groupBy("rank", "up").applyInArrow(branches(seed, level, width <= 1), "rank int, bucket long, size long, chance double, open boolean")
        step = s.put(step, f"open_{level}")
        whole = step.where("not open").select("rank", "bucket", F.col("chance").alias("drawn"))
        settled = whole if settled is None else settled.union(whole)
        if width <= 1:
            break
        now, level = step.where("open"), level + 1
    closed = grouped.where("not open").select("rank", "doc_id", "twin", "size", "rows", (F.col("copies") + F.col("chance").cast("int")).alias("copies"))
    late = grouped.where("open").join(settled, ["rank", "bucket"]).select("rank", "doc_id", "twin", "size", "rows", (F.col("copies") + F.col("drawn").cast("int")).alias("copies"))
    out = closed.union(late).join(plan.select("rank", "source", "source_size", "target"), "rank")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    own = F.expr("copies div rows + if(row < copies % rows, 1, 0)").cast("int")
    return out.select("doc_id", "twin", "source", "size", "source_size", "target", own.alias("copies"))
