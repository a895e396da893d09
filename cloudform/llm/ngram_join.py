"""N-gram Jaccard join: count vectors of shingle sets in R-trees bound the overlap, exact sets verify it.

Two texts link when their sets of distinct 5-word shingles have a Jaccard similarity of at least 75 %. The join is
exact. How it works:

1. One scan hashes each set to a fingerprint; equal sets collapse to the smallest id. The scan also counts shingles in
   a sketch of fixed size, which gives all shingles one order: common ones last, else by hash.
2. Linked sets share one of the first `n - ceil(3n/4) + 1` shingles in that order, and at least `k` of the first
   `n - ceil(3n/4) + k`. These prefixes (with k a half of the first number) meet in buckets of hashes as packed
   blocks; sets that share enough of them with sets of fitting size survive.
3. Every survivor is verified against one leader. That joins groups of near copies without their pairs.
4. For each shared shingle that still holds sets of several components, the sets' count vectors (shingles by hash
   group) go into an R-tree. The summed minima of the coordinates bound the overlap from above, for the boxes of each
   level and then for points. A shingle with many sets is dealt over a grid of blocks with a tree each.
5. Surviving pairs are verified on the sets, and components follow from all verified links. Texts travel to a pair,
   as they are smaller than the hashes of their shingles.

Nulls, empty texts and texts without words have no shingles and link with nothing. A text of fewer words than five
has its whole sequence as its one shingle. Rows with words that repeat an id are one document: they are in one component,
and a link of any of them is a link of all. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import LOWER, Powers, Scratch, U, batches, bitmap, blob, chunks, column, components, flat, marked, mix, parts, release, words

SKETCH = 1 << 22
SLICE = 1 << 16
GROUPS = 128
FAN = 16  # points of a leaf, boxes of a node
BLOCK = 256
HEADS = 8  # tokens of a set by which pairs are known that another token finds too
ENTRIES = 1 << 18  # packed at once by a task


def need(n, num: int, den: int):
    """The least overlap of a set of size n with any partner."""
    return (n * num + den - 1) // den


def first(n, num: int, den: int):
    """So many first shingles hold one that is shared."""
    return n - need(n, num, den) + 1


def more(n, num: int, den: int):
    """So many shared ones must be among the first(n) + more(n) - 1."""
    return np.maximum(first(n, num, den) // 2, 1)


def shingle_sets(data, offsets, powers: Powers, width: int = 5):
    """Distinct shingle hashes, ascending in each text, and their number in each text."""
    starts, ends, counts = words(data, offsets)
    hashes = powers.hashes(powers.sums(LOWER[data]), starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), made)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    short = counts[owner] < width
    out = np.where(short, counts[owner], 0).astype(U)
    for k in range(width):
        missing = short & (k >= counts[owner])
        h = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(len(owner), U)
        out = mix(out + np.where(missing, U(0), h), k + 1)
    bounds = np.concatenate([[0], np.cumsum(made)])
    for i in np.flatnonzero(made > 1):
        out[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(out), bool)
    if len(out) > 1:
        keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.bincount(owner[keep], minlength=n)


def segment_sums(values, counts):
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return total[bounds[1:]] - total[bounds[:-1]]


def profile(width: int):
    """doc_id, set size and 128-bit fingerprint of every text; at the end of a task its slices of the sketch."""

    def run(frames):
        powers, sketch = Powers(), np.zeros(SKETCH, np.int64)
        for batch, i, j, data, offsets in batches(frames):
            sets, sizes = shingle_sets(data, offsets, powers, width)
            slot, n = np.unique((sets >> U(42)).astype(np.int64), return_counts=True)
            sketch[slot] += n
            yield pa.RecordBatch.from_pydict({
                "doc_id": column(batch, "doc_id")[i:j].cast(pa.int64()), "n": pa.array(sizes, pa.int64()),
                "f1": segment_sums(mix(sets, 11), sizes).view(np.int64), "f2": segment_sums(mix(sets, 12), sizes).view(np.int64),
                "slice": pa.nulls(j - i, pa.int32()), "counts": pa.nulls(j - i, pa.binary())})
        slices = [k for k in range(SKETCH // SLICE) if sketch[k * SLICE : (k + 1) * SLICE].any()]
        none = pa.nulls(len(slices), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "f1": none, "f2": none, "slice": pa.array(slices, pa.int32()),
            "counts": blob([zlib.compress(sketch[k * SLICE : (k + 1) * SLICE].tobytes(), 1) for k in slices])})

    return run


def add_slices(group: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for packed in group.column("counts"):
        total += np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
    return pa.table({"slice": group.column("slice")[:1], "counts": blob([zlib.compress(total.tobytes(), 1)])})


def ranks(sketched: DataFrame) -> np.ndarray:
    """How far above the mean each counter is, in powers of two: one byte for each, 4 MB whatever the input."""
    some = sketched.where("slice is not null").select("slice", "counts", F.pmod(F.hash("counts"), F.lit(32)).alias("salt"))
    part = some.groupBy("slice", "salt").applyInArrow(add_slices, "slice int, counts binary")
    rows = part.groupBy("slice").applyInArrow(add_slices, "slice int, counts binary").collect()  # SKETCH / SLICE rows
    counts = np.zeros(SKETCH, np.int64)
    for r in rows:
        counts[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.ceil(np.log2(np.maximum(counts / max(counts.mean(), 1), 1))).astype(np.uint8)


def prefixes(order, width: int, num: int, den: int, buckets: int):
    """Packed blocks (bucket; hash, set, fingerprint and size of the sets) of the prefix shingles of a task's texts.

    A hash is cut to 32 bits next to its bucket: two that meet by chance make a candidate more, never a link.
    """

    def pack(held):
        hashes, prints, sizes, early = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket, hashes = (mix(hashes, 21) % U(buckets)).astype(np.int64), (hashes >> U(8)).astype(np.uint32)
        by = np.lexsort((prints, hashes, bucket))
        hashes, prints, sizes, bucket, early = hashes[by], prints[by], sizes[by], bucket[by], early[by]
        new = np.ones(len(by), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (prints[1:] != prints[:-1]) | (bucket[1:] != bucket[:-1])
        hashes, prints, sizes, bucket, early = hashes[new], prints[new], sizes[new], bucket[new], early[new]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, z in zip(cut, np.append(cut, len(bucket))[1:], strict=True):
            own, at = np.unique(prints[a:z], return_inverse=True)
            size = np.zeros(len(own), np.uint32)
            size[at] = sizes[a:z]
            at = (at << 1 | early[a:z]).astype(np.uint16 if len(own) < 1 << 15 else np.uint32)
            out.append((int(bucket[a]), hashes[a:z].tobytes(), at.tobytes(), own.tobytes(), size.tobytes()))
        b, h, i, p, s = zip(*out, strict=True)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int32()), "hashes": blob(h), "at": blob(i), "prints": blob(p), "sizes": blob(s)})

    def run(frames):
        powers, rank, held, n = Powers(), order.value, [], 0
        for _, _, _, data, offsets in batches(frames):
            sets, sizes = shingle_sets(data, offsets, powers, width)
            prints = segment_sums(mix(sets, 11), sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            late = rank[(sets >> U(42)).astype(np.int64)]
            by = np.lexsort((sets, late, owner))
            at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            one = first(sizes, num, den)
            keep = at < (one + more(sizes, num, den) - 1)[owner]
            early = (at < one[owner])[keep]
            sets, own = sets[by][keep], owner[keep]
            held.append((sets, prints[own], sizes[own].astype(np.uint32), early.astype(np.int64)))
            n += len(sets)
            if n >= ENTRIES:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def shared(num: int, den: int):
    """Of one bucket: (token, f1, early) for the hashes that sets of fitting sizes share."""

    def run(group: pa.Table) -> pa.Table:
        hashes, prints, sizes, early = [], [], [], []
        for k in range(len(group)):
            h, i, p, s = (group.column(c)[k].as_py() for c in ("hashes", "at", "prints", "sizes"))
            hashes.append(np.frombuffer(h, np.uint32))
            at = np.frombuffer(i, np.uint16 if len(i) < len(h) else np.uint32).astype(np.int64)
            prints.append(np.frombuffer(p, U)[at >> 1])
            sizes.append(np.frombuffer(s, np.uint32)[at >> 1])
            early.append((at & 1).astype(bool))
        hashes, prints, sizes, early = (np.concatenate(x) for x in (hashes, prints, sizes, early))
        sizes = sizes.astype(np.int64)
        by = np.lexsort((prints, sizes, hashes))
        hashes, prints, sizes, early = hashes[by], prints[by], sizes[by], early[by]
        new = np.ones(len(by), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (prints[1:] != prints[:-1])
        hashes, prints, sizes, early = hashes[new], prints[new], sizes[new], early[new]
        fits = (hashes[1:] == hashes[:-1]) & (sizes[1:] * num <= sizes[:-1] * den)
        keep = np.zeros(len(hashes), bool)
        keep[1:] |= fits
        keep[:-1] |= fits
        token = hashes[keep].astype(np.int64) | int(group.column("bucket")[0].as_py()) << 32
        return pa.table({"token": token, "f1": prints[keep].view(np.int64), "early": early[keep]})

    return run


def count_vectors(sets, sizes):
    """Shingles by hash group, as bytes; what a byte can't hold is added up in a last number."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    group = (mix(sets, 31) % U(GROUPS)).astype(np.int64)
    counts = np.bincount(owner * GROUPS + group, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS)
    return np.minimum(counts, 255).astype(np.uint8), np.maximum(counts - 255, 0).sum(1)


def members(wanted, width: int):
    """Texts and count vectors of the rows whose id may be wanted."""

    def run(frames):
        powers = Powers()
        for batch, i, j, data, offsets in batches(marked(b, "doc_id", wanted.value) for b in frames):
            sets, sizes = shingle_sets(data, offsets, powers, width)
            counts, excess = count_vectors(sets, sizes)
            yield pa.RecordBatch.from_pydict({"rep": column(batch, "doc_id")[i:j].cast(pa.int64()), "n": pa.array(sizes, pa.int64()),
                "f1": segment_sums(mix(sets, 11), sizes).view(np.int64), "text": column(batch, "text")[i:j].cast(pa.string()),
                "counts": blob([x.tobytes() for x in counts]), "excess": pa.array(excess, pa.int64())})

    return run


class Forest:
    """An R-tree for each block of points, all in the same arrays.

    The points of a block are sorted by slabs of size and then by a tile of their coordinates; runs of FAN make leaves,
    runs of FAN leaves make nodes, up to one root. A box holds the largest coordinates, the range of sizes and the place of
    its last point.
    """

    def __init__(self, block: np.ndarray, points: np.ndarray, sizes: np.ndarray, excess: np.ndarray):
        n = len(block)
        by = np.lexsort((sizes, block))
        start = np.concatenate([[True], np.diff(block[by]) != 0])
        length = np.diff(np.append(np.flatnonzero(start), n))
        rank = np.arange(n) - np.repeat(np.flatnonzero(start), length)
        slab = np.repeat(np.maximum(FAN, np.sqrt(length * FAN)).astype(np.int64), length)
        half = points[:, : GROUPS // 2].sum(1, dtype=np.int64)
        self.order = by[np.lexsort((half[by], rank // slab, block[by]))]
        self.points, self.sizes, self.excess, owner = points[self.order], sizes[self.order], excess[self.order], block[self.order]
        level = (self.points, self.sizes, self.sizes, self.excess, np.arange(n), owner)
        self.levels = []  # of boxes: coordinates, smallest and largest size, excess, last point, first child, children
        while True:
            high, small, large, spare, last, owner = level
            start = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
            length = np.diff(np.append(start, len(owner)))
            inside = np.arange(len(owner)) - np.repeat(start, length)
            cut = np.flatnonzero(inside % FAN == 0)
            level = (np.maximum.reduceat(high, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut), np.maximum.reduceat(spare, cut), np.maximum.reduceat(last, cut), owner[cut])
            self.levels.append((*level[:5], cut, np.diff(np.append(cut, len(owner)))))
            if len(cut) == len(start):
                break
        self.root = np.repeat(np.arange(len(cut)), np.diff(np.append(np.flatnonzero(np.concatenate([[True], np.diff(self.sorted(block)) != 0])), n)))

    def sorted(self, values: np.ndarray) -> np.ndarray:
        return values[self.order]

    def pairs(self, num: int, den: int, points: int = 4096):
        """Pairs of points of one block, by their places before sorting, that no box on the way down rules out.

        The summed minima with a box bound every overlap in it; what the bytes of both can't hold is shared at most up
        to the smaller excess.
        """
        for a in range(0, len(self.order), points):
            q = np.arange(a, min(a + points, len(self.order)))
            node = self.root[q]
            for high, small, large, spare, last, first, count in reversed(self.levels):
                fits = (small[node] * num <= self.sizes[q] * den) & (self.sizes[q] * num <= large[node] * den) & (last[node] > q)
                q, node = q[fits], node[fits]
                good = np.zeros(len(q), bool)
                for i in range(0, len(q), 1 << 15):
                    x, y = q[i : i + (1 << 15)], node[i : i + (1 << 15)]
                    most = np.minimum(self.points[x], high[y]).sum(1, dtype=np.int64) + np.minimum(self.excess[x], spare[y])
                    good[i : i + (1 << 15)] = most * (num + den) >= (self.sizes[x] + small[y]) * num
                q, node = q[good], node[good]
                size = count[node]
                q, node = np.repeat(q, size), np.repeat(first[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            later = node > q
            yield self.order[q[later]], self.order[node[later]]


def bounded(a, z, points, sizes, excess, num, den):
    """Which pairs of points a, z may reach the threshold: overlap * (num + den) >= num * (size + size)."""
    keep = (sizes[a] * num <= sizes[z] * den) & (sizes[z] * num <= sizes[a] * den)
    a, z = a[keep], z[keep]
    out = []
    for i in range(0, len(a), 1 << 15):
        x, y = a[i : i + (1 << 15)], z[i : i + (1 << 15)]
        most = np.minimum(points[x], points[y]).sum(1, dtype=np.int64) + np.minimum(excess[x], excess[y])
        out.append(most * (num + den) >= num * (sizes[x] + sizes[y]))
    good = np.concatenate(out) if out else np.zeros(0, bool)
    return a[good], z[good]


def candidates(num: int, den: int):
    """Pairs of different components in the blocks of one bucket that their count vectors let through."""

    def run(group: pa.Table) -> pa.Table:
        get = lambda name: group.column(name).to_numpy()
        token, row, col, rep, comp, size, excess, own = map(get, ("token", "row", "col", "rep", "comp", "n", "excess", "own"))
        points = np.frombuffer(b"".join(x.as_py() for x in group.column("counts")), np.uint8).reshape(-1, GROUPS)
        heads = np.stack([np.array(x.as_py(), np.int64) for x in group.column("heads")])
        by = np.lexsort((rep, col, row, token))
        new = np.concatenate([[True], np.any([np.diff(x[by]) != 0 for x in (token, row, col)], axis=0)])
        block = np.empty(len(by), np.int64)
        block[by] = np.cumsum(new)
        out = [np.zeros((0, 2), np.int64)]
        for a, z in Forest(block, points, size, excess).pairs(num, den):
            keep = (comp[a] != comp[z]) & (rep[a] != rep[z])
            keep &= (row[a] == col[a]) | (own[a] != own[z])  # off the diagonal only pairs across the two chunks
            a, z = bounded(a[keep], z[keep], points, size, excess, num, den)
            seen = np.zeros(len(a), bool)  # a smaller token that both hold has let the pair through already
            for k in range(HEADS):
                seen |= ((heads[a, k][:, None] == heads[z]) & (heads[a, k] < token[a])[:, None]).any(1)
            a, z = a[~seen], z[~seen]
            out.append(np.unique(np.stack([np.minimum(rep[a], rep[z]), np.maximum(rep[a], rep[z])], 1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def linked(width: int, num: int, den: int):
    """The pairs (a, b) of texts whose sets reach the threshold, by their exact intersection."""

    def run(frames):
        powers = Powers()
        for batch in frames:
            (xd, xo), (yd, yo) = flat(column(batch, "x")), flat(column(batch, "y"))
            keep = np.zeros(len(batch), bool)
            for i, j in chunks(xo + yo):
                data = np.concatenate([xd[xo[i] : xo[j]], yd[yo[i] : yo[j]]])
                offsets = np.concatenate([xo[i : j + 1] - xo[i], xo[j] - xo[i] + yo[i + 1 : j + 1] - yo[i]])
                sets, sizes = shingle_sets(data, offsets, powers, width)
                pair = np.repeat(np.tile(np.arange(j - i), 2), sizes)
                by = np.lexsort((sets, pair))
                both = (sets[by][1:] == sets[by][:-1]) & (pair[by][1:] == pair[by][:-1])
                n = np.bincount(pair[by][1:][both], minlength=j - i)
                total = sizes[: j - i] + sizes[j - i :]
                keep[i:j] = n * den >= (total - n) * num
            yield batch.filter(pa.array(keep)).select(["a", "b"])
        release()

    return run


def verified(pairs: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    x = sets.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(linked(width, num, den), "a long, b long").distinct()


def ngram_jaccard_join(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of docs(doc_id, text).

    Null ids are kept with the component null.
    """
    spark = docs.sparkSession
    s, num, den, n = Scratch(spark), percent, 100, parts(spark)
    texts = docs.select("doc_id", "text")
    scanned = s.put(texts.mapInArrow(profile(width), "doc_id long, n long, f1 long, f2 long, slice int, counts binary"), "profile")
    order = spark.sparkContext.broadcast(ranks(scanned))  # SKETCH bytes
    rows = scanned.where("slice is null").select("doc_id", "n", "f1", "f2")
    reps = s.put(rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "reps")

    entries = (reps.agg(F.sum("n")).first()[0] or 0) * (den - num) * 3 // (2 * den)
    n_parts = max(n, entries >> 20)
    packed = texts.mapInArrow(prefixes(order, width, num, den, 4 * n_parts), "bucket int, hashes binary, at binary, prints binary, sizes binary")
    cells = packed.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(shared(num, den), "token long, f1 long, early boolean")
    cells = s.put(cells, "cells")
    least = F.expr(f"(n * {num} + {den - 1}) div {den}")  # the size of the smallest partner
    enough = F.greatest(F.expr(f"(least - (least * {num} + {den - 1}) div {den} + 1) div 2"), F.lit(1))
    held = s.put(cells.groupBy("f1").agg(F.count("*").alias("held")), "held")
    alive = s.put(reps.join(held, "f1").withColumn("least", least).where(F.col("held") >= enough).select("f1", "rep", "n"), "alive")

    # Ids of several rows: their sets stand for one document.
    often = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("held"))
    often = s.put(rows.join(often.where("held > 1"), "doc_id", "left_semi").where("n > 0").join(reps, ["f1", "f2"]).select("doc_id", "rep").distinct(), "often")
    same = often.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    wanted = spark.sparkContext.broadcast(bitmap(alive, "rep"))
    found = texts.where("doc_id is not null").mapInArrow(members(wanted, width), "rep long, n long, f1 long, text string, counts binary, excess long")
    if often.limit(1).count():  # else every row of a wanted id is the wanted one
        found = found.join(alive.select("rep", "f1"), ["rep", "f1"], "left_semi").dropDuplicates(["rep", "f1"])
    sets = s.put(found.drop("f1"), "sets")

    near = s.put(cells.where("early").join(alive, "f1").select("token", "rep", "n"), "near")
    s.drop("cells", "held", "alive")  # each table goes once the next ones hold what is needed of it
    heads = s.put(near.groupBy("token").agg(F.min("rep").alias("leader")), "leaders")
    led = near.join(heads, "token").where("rep <> leader").groupBy("leader", "rep").count()
    best = s.put(led.groupBy("rep").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("a")), "best")
    one = s.put(verified(best.select("a", F.col("rep").alias("b")), sets, width, num, den).union(same), "links_1")
    comp = components(s, one, "comp_1")

    marked = s.put(near.join(comp, near.rep == comp.v, "left").select("token", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "marked")
    s.drop("near", "leaders", "best")
    mixed = s.put(marked.groupBy("token").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "held"), "mixed")
    across = s.put(marked.join(mixed, "token"), "across")
    s.drop("marked", "mixed")
    side = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), side).cast("int")
    dealt = across.select("*", side.alias("side"), own.alias("own")).select("token", "rep", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other"))
    dealt = dealt.select("token", "rep", "comp", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))
    least = F.slice(F.sort_array(F.collect_list("token")), 1, HEADS)
    heads = across.groupBy("rep").agg(F.concat(least, F.array_repeat(F.lit((1 << 63) - 1), F.greatest(HEADS - F.size(least), F.lit(0)))).alias("heads"))
    points = s.put(sets.select("rep", "n", "counts", "excess").join(heads, "rep"), "points")
    full = dealt.join(points, "rep")
    full = full.withColumn("bucket", F.pmod(F.xxhash64("token", "row", "col"), F.lit(8 * n)))
    pairs = full.groupBy("bucket").applyInArrow(candidates(num, den), "a long, b long")
    two = s.put(verified(s.put(pairs.distinct(), "pairs"), sets, width, num, den), "links_2")
    comp = components(s, one.union(two), "comp_2")

    known = s.put(reps.join(comp, reps.rep == comp.v, "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp")), "known")
    s.drop("reps", "sets", "often", "across", "points", "pairs", "links_1", "links_2", *(f"comp_{k}_{t}" for k in (1, 2) for t in ("links", "0", "1", "2", "spread")))
    empty = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = rows.where("n > 0 and doc_id is not null").join(known, ["f1", "f2"])
    return rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id")).union(empty)
