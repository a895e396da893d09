"""A Merkle manifest of a table: a digest for each row, trees of digests, and proofs by coordinate lookup.

H is the lowercase hex SHA-256 of its inputs one after the other. A row's leaf is H of its columns, each as its UTF-8 byte
count, a colon and the value, or `-` where null. Leaves of one group ascend by id and every `fan` consecutive ones become
their H, level by level, until one is left, the group's subroot; subroots ascend by group and give the root likewise.

Proofs: each leaf explodes the coordinates of the nodes it needs, which follow from its index and the size of its group:
one coordinate a level, as all siblings of a level stand in one run of `fan`. They are joined with the table of nodes, a
row a run. Levels of few runs are joined by broadcast, so that runs which very many leaves need gather in no task; the
others have at least `SMALL` runs in all. Ordered and concatenated, the siblings make the proof, which is folded with
the row's leaf to a root again.

Ranks come from a table that is range-partitioned and written once, then numbered by ranges, so a group of any size is
dealt over tasks. A null group is one group and comes first; null ids come first. Rows that repeat an id stand by their
leaves' order; equal rows have equal leaves and any order of theirs gives the same result. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import Scratch
from .license_scan import SMALL as LETTERS
from .license_scan import UPPER

FAN = 8
SMALL = 1 << 13  # runs of upper levels that are broadcast, of at most fan digests each


def digest(x: F.Column) -> F.Column:
    return F.sha2(x.cast("binary"), 256)


def field(x: F.Column) -> F.Column:
    value = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: list[F.Column]) -> F.Column:
    return digest(F.concat(*map(field, columns)))


def numbered(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written once, with place: a number from 0 without a gap in a total order.

    Ranges of the order are numbered from the sizes of the ranges before; a row for each range is sorted in one task.
    """
    cuts = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).withColumn("part", F.spark_partition_id())
    cuts = scratch.put(cuts, name)
    sizes = cuts.groupBy("part").agg(F.count("*").alias("size"))
    start = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return cuts.withColumn("own", own).join(F.broadcast(start), "part").withColumn("place", F.col("start") + F.col("own") - 1).drop("part", "own", "start")


def levels_of(size, fan: int) -> F.Column:
    """How often `size` nodes become a `fan`-th of them, rounded up, until one is left."""
    powers = [fan**i for i in range(64) if fan**i < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < size))


def together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def trees(scratch: Scratch, leaves: DataFrame, name: str, fan: int = FAN) -> tuple[DataFrame | None, DataFrame]:
    """(runs, roots) of leaves(tree, k, of, node): k runs from 0 to of - 1 in each tree, digests are 32 bytes each.

    runs(tree, level, run, nodes): the digests of up to `fan` consecutive nodes, one after the other; none where every
    tree has one node. roots(tree, node). A job for each level over a `fan`-th of the rows of the one before.
    """
    nodes, runs, roots = leaves.select("tree", "k", "of", "node"), [], []
    while True:
        roots.append(nodes.where("of = 1").select("tree", "node"))
        open_ = nodes.where("of > 1")
        if not open_.limit(1).count():
            return together(runs) if runs else None, together(roots)
        own = F.sort_array(F.collect_list(F.struct("k", "node")))
        packed = open_.groupBy("tree", "of", F.floor(F.col("k") / fan).alias("run")).agg(own.alias("own"))
        level = scratch.put(packed.select("tree", "of", "run", F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x.node)).alias("nodes")), f"{name}_{len(runs)}")
        runs.append(level.select("tree", F.lit(len(runs)).alias("level"), "run", "nodes"))
        nodes = level.select("tree", F.col("run").alias("k"), F.ceil(F.col("of") / fan).alias("of"), F.unhex(digest(F.lower(F.hex("nodes")))).alias("node"))


def proofs(leaves: DataFrame, runs: DataFrame, fan: int = FAN, small: int = SMALL) -> DataFrame:
    """(tree, k, steps) of each leaf of leaves(tree, k, of) with siblings: their digests (before, after), level by level."""
    counts = {r.level: r["count"] for r in runs.groupBy("level").count().collect()}  # a row for each level
    high = {v for v in counts if sum(n for u, n in counts.items() if u >= v) <= small}
    wanted = leaves.where("of > 1").select("tree", "k", F.explode(F.sequence(F.lit(0), levels_of(F.col("of"), fan) - 1)).alias("level"))
    widths = F.array(*(F.lit(fan**v).cast("long") for v in sorted(counts)))
    wanted = wanted.withColumn("at", F.floor(F.col("k") / F.get(widths, F.col("level")))).withColumn("run", F.floor(F.col("at") / fan))
    found = []
    for some, hint in ((sorted(set(counts) - high), lambda x: x), (sorted(high), F.broadcast)):
        if some:
            found.append(wanted.where(F.col("level").isin(some)).join(hint(runs.where(F.col("level").isin(some))), ["tree", "level", "run"]))
    rows = together(found).select("tree", "k", "level", (F.col("at") % fan).cast("int").alias("own"), "nodes")
    steps = rows.groupBy("tree", "k").agg(F.sort_array(F.collect_list(F.struct("level", "own", "nodes"))).alias("steps"))
    part = lambda x, a, n: F.lower(F.hex(F.substring(x.nodes, a, n)))
    pair = lambda x: F.struct(part(x, F.lit(1), 32 * x.own).alias("before"), part(x, 32 * x.own + 33, F.lit(32 * fan)).alias("after"))
    return steps.select("tree", "k", F.transform("steps", pair).alias("steps"))


def folded(leaf: F.Column, steps: F.Column) -> F.Column:
    return F.aggregate(steps, leaf, lambda a, x: digest(F.concat(x.before, a, x.after)))


def lowered() -> F.Column:
    """The text after tampering: A-Z in lower case where 3 divides the CRC-32 of the decimal doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LETTERS)).otherwise(F.col("text"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, *, id_: str = "doc_id", group: str = "lang", claim: F.Column | None = None, fan: int = FAN, small: int = SMALL) -> DataFrame:
    """id, leaf, subroot, root, proof (hex digests one after the other), folded_root and verified of each row of docs.

    `claim` is the leaf that a row claims to have, as a column of docs; without one it is the leaf itself. The proof is
    folded from it. Columns other than those named don't enter, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    leaf = leaf_of([F.col(f"`{c}`") for c in columns])
    rows = docs.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{group}`").cast("string").alias("lang"), F.unhex(leaf).alias("node"), F.unhex(leaf if claim is None else claim).alias("claim"))
    rows = scratch.put(numbered(scratch, rows, ["lang", "id", "node"], "ranged"), "leaves")

    groups = rows.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("of"))
    groups = scratch.put(numbered(scratch, groups, ["lang"], "groups").withColumnRenamed("place", "tree"), "trees")
    n = groups.count()
    few = F.broadcast if n <= small else lambda x: x
    leaves = rows.join(few(groups.withColumnRenamed("lang", "own")), F.col("lang").eqNullSafe(F.col("own")))
    leaves = scratch.put(leaves.select("tree", (F.col("place") - F.col("first")).alias("k"), "of", "id", "node", "claim"), "indexed")
    runs, roots = trees(scratch, leaves, "nodes", fan)

    tops = scratch.put(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("k"), F.lit(n).cast("long").alias("of"), "node"), "subroots")
    top_runs, top = trees(scratch, tops, "tops", fan)
    root = top.first()
    none = F.array().cast("array<struct<before:string,after:string>>")
    over = tops.select(F.col("k").alias("tree"), F.lower(F.hex("node")).alias("subroot"))
    if top_runs is not None:
        over = over.join(proofs(tops, top_runs, fan, small).select(F.col("k").alias("tree"), F.col("steps").alias("more")), "tree", "left")
    over = scratch.put(over if "more" in over.columns else over.withColumn("more", none), "over")

    out = leaves.join(proofs(leaves, runs, fan, small), ["tree", "k"], "left") if runs is not None else leaves.withColumn("steps", none)
    out = out.join(few(over), "tree").select(
        F.col("id").alias(id_), F.lower(F.hex("node")).alias("leaf"), F.lower(F.hex("claim")).alias("claim"), "subroot",
        F.lit(root and root.node.hex()).cast("string").alias("root"), F.concat(F.coalesce("steps", none), F.coalesce("more", none)).alias("steps"))
    proof = F.array_join(F.transform("steps", lambda x: F.concat(x.before, x.after)), "")
    out = out.select(id_, "leaf", "subroot", "root", proof.alias("proof"), folded(F.col("claim"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
