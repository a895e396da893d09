"""Suffix-array dedup: removes every byte that a 200-byte string covers which also starts somewhere else.

Texts are UTF-8 bytes, matches never cross texts, overlaps count, strings are judged on the input. Exact:

1. Every 200-byte string is filed under the smallest hash of its 64-byte pieces; neighbouring strings with the same
   smallest piece form a tile. Equal strings have equal pieces, so a tile whose piece occurs nowhere else holds no
   repeat, and a tile whose bytes occur twice is all repeats. This settles nearly all text.
2. What is left (tiles whose piece recurs in other surroundings) goes into shards with a suffix array each, sorted by
   Larsson-Sadakane refinement; Kasai common prefixes tell the strings that repeat inside the shard.
3. Each shard sends every distinct string once, as a sorted run of fingerprints. The runs meet by binary search in
   buckets of fingerprints, which tells the strings that repeat across shards.

Nulls count as empty. Texts under 200 bytes lose nothing. Rows that repeat an id are texts of their own; several rows
with the same id and text are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import Powers, Scratch, U, batches, blob, chunks, column, flat, longs, mix, parts, release, sieved

PIECE = 64
POSITION = 24  # bits; longer texts are cut in pieces of 2**23 strings
WINDOW = 1 << 17  # bytes of texts whose tiles are made at once, some 70 bytes of arrays for each
ENTRIES = 1 << 17
SHARD = 1 << 19
HELD = 1 << 23  # bytes of whole texts that a shard holds at most, but for one text
LANES = 2048
KEYS = "k1 long, k2 long"
RESULT = "n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def tiles(data, offsets, length: int, powers: Powers):
    """(text, first string, strings, hash of the piece, hash of the bytes) of each tile of the texts."""
    if len(data) > 1 << POSITION - 1:
        out, step = [], 1 << POSITION - 2
        for i in range(len(offsets) - 1):
            for a in range(0, max(int(offsets[i + 1] - offsets[i]) - length + 1, 0), step):
                some = data[offsets[i] + a : min(offsets[i] + a + step + length - 1, offsets[i + 1])]
                _, s, n, m, t = tiles(some, np.array([0, len(some)]), length, powers)
                out.append((np.full(len(s), i), s + a, n, m, t))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tiles(data[:0], np.zeros(1, np.int64), length, powers)
    n = len(data) - length + 1
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n <= 0 or not (whole := owner[:n] == owner[length - 1 :]).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U)
    sums = powers.sums(data)
    spots = np.arange(len(data) - PIECE + 1)
    pieces = mix((sums[PIECE:] - sums[:-PIECE]) * powers.down[spots])
    low = pieces >> U(POSITION) << U(POSITION) | spots.astype(U)
    width, done = length - PIECE + 1, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    at = (low & U((1 << POSITION) - 1)).astype(np.int64)
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | (owner[1:n] != owner[: n - 1]) | ~whole[:-1]
    first = np.flatnonzero(new)
    last = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
    return owner[first], first - offsets[owner[first]], last - first + 1, pieces[at[first]], powers.hashes(sums, first, last + length)


def packed(bucket, **arrays):
    """Rows (bucket, one binary for each array) of values dealt by bucket; arrays come sorted by it."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut, len(bucket))[1:]
    return {"bucket": pa.array(bucket[cut], pa.int32())} | {k: blob([v[a:z].tobytes() for a, z in zip(cut, ends, strict=True)]) for k, v in arrays.items()}


def tile_blocks(length: int, buckets: int):
    def pack(held):
        k1, k2, start, count, piece, whole = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (mix(piece, 41) % U(buckets)).astype(np.int64)
        by = np.lexsort((whole, piece, bucket))
        return pa.RecordBatch.from_pydict(packed(bucket[by], k1=k1[by], k2=k2[by], start=start[by], count=count[by], piece=piece[by], whole=whole[by]))

    def run(frames):
        release()  # what an earlier task of this worker left
        powers, held, n = Powers(), [], 0
        for batch, i, j, data, offsets in batches(frames, most=WINDOW):
            owner, start, count, piece, whole = tiles(data, offsets, length, powers)
            k1, k2 = longs(batch, "k1")[i:j], longs(batch, "k2")[i:j]
            held.append((k1[owner], k2[owner], start.astype(np.uint32), count.astype(np.uint16), piece, whole))
            n += len(owner)
            if n >= ENTRIES:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)
        held = []
        release()

    return run


def read(group: pa.Table, **kinds):
    return [np.frombuffer(b"".join(x.as_py() for x in group.column(k)), kind) for k, kind in kinds.items()]


def tile_states(group: pa.Table) -> pa.Table:
    """Tiles with a recurring piece. state 1: repeats throughout; 2: so too, and others need its strings; 3: open."""
    k1, k2, start, count, piece, whole = read(group, k1=np.int64, k2=np.int64, start=np.uint32, count=np.uint16, piece=U, whole=U)
    by = np.lexsort((whole, piece))
    piece, whole = piece[by], whole[by]
    new_piece = np.ones(len(by), bool)
    new_piece[1:] = piece[1:] != piece[:-1]
    new_tile = new_piece.copy()
    new_tile[1:] |= whole[1:] != whole[:-1]
    p, t = np.cumsum(new_piece) - 1, np.cumsum(new_tile) - 1
    kinds = np.bincount(p[new_tile])[p]
    copies = np.bincount(t)[t]
    state = np.where(copies > 1, np.where((kinds > 1) & new_tile, 2, 1), 3)
    keep = (kinds > 1) | (copies > 1)
    by = by[keep]
    return pa.table({"k1": k1[by], "k2": k2[by], "start": start[by].astype(np.int64), "count": count[by].astype(np.int32), "state": state[keep].astype(np.int32)})


def lists(array: pa.Array, field: str | None = None):
    """Values and n + 1 offsets of a list column; nulls are empty."""
    counts = np.asarray(array.value_lengths().fill_null(0))
    values = array.flatten()
    if field:
        values = values.field(values.type.get_field_index(field))
    return values.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def strip(texts, starts, counts, cut, length: int):
    """Sizes, maximal removed spans and kept bytes of texts, given runs of repeated strings (first, how many)."""
    data, offsets = flat(texts)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    edge = np.zeros(len(data) + len(offsets) - 1, np.int32)  # one place more for each text, so no span meets the next
    base = offsets[:-1] + np.arange(len(offsets) - 1)
    np.add.at(edge, base[owner] + starts, 1)
    np.add.at(edge, base[owner] + starts + counts + length - 1, -1)
    gone = np.cumsum(edge) > 0
    change = np.diff(gone.astype(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    whose = np.searchsorted(base, first, "right") - 1
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(offsets))).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(first - base[whose], pa.int64()), pa.array(after - base[whose], pa.int64())], ["start", "stop"]))
    inside = np.ones(len(edge), bool)
    inside[offsets[1:] + np.arange(len(offsets) - 1)] = False
    stay = ~gone[inside]
    ends = np.concatenate([[0], np.cumsum(stay)])[offsets]
    rest = data[stay].tobytes()
    kept = blob([rest[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    return pa.array(np.diff(offsets), pa.int64()), spans, kept


# ---------------------------------------------------------------- suffix arrays of a shard
def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of all suffixes.

    Larsson-Sadakane: the first order is by seven bytes, nine bits each, so that the end of the data sorts before every
    byte; then only groups that are still tied are refined, each by the rank of the suffix h bytes further on, and h
    doubles.
    """
    n = len(data)
    wide = np.concatenate([data.astype(np.uint16) + np.uint16(1), np.zeros(7, np.uint16)])
    key = np.zeros(n, U)
    for k in range(7):
        key <<= U(9)
        key |= wide[k : n + k]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del wide, key
    spots, zero = np.arange(n, dtype=np.int32), np.int32(0)
    head = np.maximum.accumulate(np.where(new, spots, zero))
    rank = np.empty(n, np.int32)
    rank[order] = head
    h = 7
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied).astype(np.int32)
        if not len(places):
            break
        own = order[places]
        then = np.where(own < n - h, rank[np.minimum(own, n - 1 - min(h, n - 1)) + min(h, n - 1)] + 1, zero)
        by = np.lexsort((then, rank[own]))
        own, then = own[by], then[by]
        group = rank[own]
        order[places] = own
        new[places] = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        head = np.maximum.accumulate(np.where(new, spots, zero))
        rank[own] = head[places]
        h *= 2
    place = np.empty(n, np.int32)
    place[order] = spots
    return order, place


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Kasai: the common prefix (up to `most`) of each suffix with the one before it in the order.

    The text is cut in lanes that go on at once: in its lane, each suffix starts from the length found for the last
    suffix, less one.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    text = np.concatenate([data.astype(np.int16), np.arange(-1, -2, -1, dtype=np.int16)])
    lanes = min(LANES, n)
    at = np.linspace(0, n, lanes + 1).astype(np.int64)
    at, stop = at[:-1].copy(), at[1:]
    h = np.zeros(lanes, np.int64)
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(at < stop)
    while len(live):
        i = at[live]
        j = before[i]
        k = h[live]
        x, y = np.minimum(i + k, n), np.minimum(j + k, n)
        more = (j >= 0) & (k < most) & (x < n) & (y < n) & (text[x] == text[y])
        h[live[more]] += 1
        over = live[~more]
        out[at[over]] = h[over]
        h[over] = np.maximum(h[over] - 1, 0)
        at[over] += 1
        live = live[at[live] < stop[live]]
    return out[order]


def shard_runs(length: int, buckets: int):
    """Of each shard: the open strings that repeat in it, and one fingerprint for each distinct string."""

    def shard(held, powers):
        k1, k2, texts, starts, counts, states = zip(*held, strict=True)
        pieces, spots, owner, place_of, is_open = [], [], [], [], []
        base = 0
        for d, (text, s, c, q) in enumerate(zip(texts, starts, counts, states, strict=True)):
            use = q >= 2
            by = np.argsort(s[use], kind="stable")
            s, c, q = s[use][by], c[use][by], q[use][by]
            end = 0
            at = np.repeat(s, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)  # all strings of these tiles
            cut = np.flatnonzero(np.diff(at, prepend=-length - 1) > length)  # far apart: regions of their own
            for a, z in zip(cut, np.append(cut, len(at))[1:], strict=True):
                pieces.append(text[at[a] : at[z - 1] + length])
                spots.append((at[a:z] - at[a] + base).astype(np.int32))
                base += len(pieces[-1])
            owner.append(np.full(len(at), d, np.int32))
            place_of.append(at.astype(np.uint32))
            is_open.append(np.repeat(q == 3, c))
        data, spots, owner, at, is_open = (np.concatenate(x) for x in (pieces, spots, owner, place_of, is_open))
        del pieces, place_of
        order, place = suffix_array(data)
        kind = np.cumsum(common_prefixes(data, order, place, length) < length, dtype=np.int32)[place[spots]]
        del order, place
        _, first, kind, n = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
        found = is_open & (n[kind] > 1)
        k1, k2 = np.array(k1, np.int64), np.array(k2, np.int64)
        hit = np.flatnonzero(found)
        cut = np.flatnonzero(np.diff(owner[hit], prepend=-1))
        ends = np.append(cut, len(hit))[1:].astype(np.int64)
        whose = owner[hit[cut]]
        local = {"bucket": pa.array((mix(k2[whose].view(U), 44) % U(buckets)).astype(np.int32)), "d1": blob([x.tobytes() for x in k1[whose]]), "d2": blob([x.tobytes() for x in k2[whose]]),
                 "known": blob([at[hit[a:z]].tobytes() for a, z in zip(cut, ends, strict=True)])}
        sums = powers.sums(data)
        prints = powers.hashes(sums, spots[first], spots[first] + length)
        asks = is_open[first] & (n == 1)
        bucket = (mix(prints, 43) % U(buckets)).astype(np.int64)
        by = np.lexsort((prints, ~asks, bucket))
        f, prints, asks, bucket = first[by], prints[by], asks[by], bucket[by]
        rows = []
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, z in zip(cut, np.append(cut, len(bucket))[1:], strict=True):
            asked = f[a : a + asks[a:z].sum()]
            docs, index = np.unique(owner[asked], return_inverse=True)
            rows.append((bucket[a], prints[a:z].tobytes(), index.astype(np.uint32).tobytes(), at[asked].tobytes(), k1[docs].tobytes(), k2[docs].tobytes()))
        b, p, i, s, d1, d2 = zip(*rows, strict=True)
        return local, {"bucket": pa.array(np.array(b, np.int32)), "prints": blob(p), "index": blob(i), "at": blob(s), "d1": blob(d1), "d2": blob(d2)}

    names = ("prints", "index", "at", "d1", "d2", "known")

    def row(table):
        return pa.RecordBatch.from_pydict({"bucket": table["bucket"]} | {k: table[k] if k in table else pa.nulls(len(table["bucket"]), pa.binary()) for k in names})

    def run(frames):
        release()  # what an earlier task of this worker left
        powers, held, size, taken = Powers(), [], 0, 0
        for batch in frames:
            data, offsets = flat(column(batch, "text"))
            cols = [lists(column(batch, "tiles"), k) for k in ("start", "count", "state")]
            k1, k2, cut = longs(batch, "k1"), longs(batch, "k2"), cols[0][1]
            for i in range(len(batch)):
                held.append((k1[i], k2[i], data[offsets[i] : offsets[i + 1]].copy(), *(v[cut[i] : cut[i + 1]].copy() for v, _ in cols)))
                size += int((held[-1][4] * (held[-1][5] >= 2)).sum()) * 2
                taken += len(held[-1][2])
                if size >= SHARD or taken >= HELD:
                    yield from map(row, shard(held, powers))
                    held, size, taken = [], 0, 0
        if held:
            yield from map(row, shard(held, powers))
        held = []
        release()

    return run


def across(buckets: int):
    """Strings of one bucket that several shards sent: each sorted run is searched in all runs together.

    What a shard has found alone passes through. The repeats go out packed, a row for each bucket of texts.
    """

    def run(group: pa.Table) -> pa.Table:
        get = lambda name, k, kind: np.frombuffer(group.column(name)[k].as_py(), kind)
        runs = [k for k in range(len(group)) if group.column("prints")[k].is_valid]
        prints = {k: get("prints", k, U) for k in runs}
        seen = np.sort(np.concatenate([np.zeros(0, U), *prints.values()]))
        out = [np.zeros((0, 3), np.int64)]
        for k in range(len(group)):
            d1, d2 = get("d1", k, np.int64), get("d2", k, np.int64)
            if k in prints:
                index, at = get("index", k, np.uint32), get("at", k, np.uint32)
                asked = prints[k][: len(index)]
                hit = np.searchsorted(seen, asked, "right") - np.searchsorted(seen, asked, "left") > 1
                out.append(np.stack([d1[index[hit]], d2[index[hit]], at[hit].astype(np.int64)], 1))
            else:
                at = get("known", k, np.uint32)
                out.append(np.stack([np.full(len(at), d1[0]), np.full(len(at), d2[0]), at.astype(np.int64)], 1))
        d1, d2, at = np.concatenate(out).T
        to = (mix(d2.copy().view(U), 44) % U(buckets)).astype(np.int64)
        by = np.lexsort((at, d2, d1, to))
        return pa.table(packed(to[by], d1=d1[by], d2=d2[by], at=at[by].astype(np.uint32)))

    return run


def by_text(group: pa.Table) -> pa.Table:
    """All repeats of each text of one bucket."""
    d1, d2, at = read(group, d1=np.int64, d2=np.int64, at=np.uint32)
    by = np.lexsort((at, d2, d1))
    d1, d2, at = d1[by], d2[by], at[by].astype(np.int64)
    new = np.ones(len(by), bool)
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    cut = np.flatnonzero(new)
    return pa.table({"k1": d1[cut], "k2": d2[cut], "found": blob([at[a:z].tobytes() for a, z in zip(cut, np.append(cut, len(by))[1:], strict=True)])})


def with_fields(head: T.StructType, ddl: str) -> T.StructType:
    return T.StructType(head.fields + T.StructType.fromDDL(ddl).fields)


def finished(length: int):
    def run(frames):
        for whole in frames:
            for i, j in chunks(flat(column(whole, "text"))[1]):
                batch = whole.slice(i, j - i)
                starts, cut = lists(column(batch, "tiles"), "start")
                counts, _ = lists(column(batch, "tiles"), "count")
                state, _ = lists(column(batch, "tiles"), "state")
                owner = np.repeat(np.arange(len(batch)), np.diff(cut))[state <= 2]
                more = [np.frombuffer(x or b"", np.int64) for x in column(batch, "found").to_pylist()]
                all_s = np.concatenate([starts[state <= 2], *more])
                all_c = np.concatenate([counts[state <= 2], np.ones(len(all_s) - (state <= 2).sum(), np.int64)])
                whose = np.concatenate([owner, np.repeat(np.arange(len(batch)), [len(x) for x in more])])
                by = np.argsort(whose, kind="stable")
                n_bytes, spans, kept = strip(column(batch, "text"), all_s[by], all_c[by], np.searchsorted(whose[by], np.arange(len(batch) + 1)), length)
                yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "rest": column(batch, "rest"), "n_bytes": n_bytes, "spans": spans, "kept": kept})
        release()

    return run


def suffix_dedup(docs: DataFrame, *, length: int = 200) -> DataFrame:
    """doc_id, rest (a struct of the other columns of docs, whatever their names), n_bytes, spans (start and stop of the
    maximal removed runs) and kept (the remaining bytes) of each row of docs(doc_id, text, ...).
    """
    assert length >= PIECE
    spark = docs.sparkSession
    s, n = Scratch(spark), parts(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(True).alias("none"))
    texts = docs.select("doc_id", rest.alias("rest"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("*", F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = max(n, size >> 25)  # tasks, so that a task's share doesn't grow with the input
    head = T.StructType([texts.schema["doc_id"], texts.schema["rest"]])
    blocks = texts.select("k1", "k2", "text").mapInArrow(tile_blocks(length, 4 * dealt), "bucket int, k1 binary, k2 binary, start binary, count binary, piece binary, whole binary")
    states = blocks.repartition(dealt, "bucket").groupBy("bucket").applyInArrow(tile_states, f"{KEYS}, start long, count int, state int")
    states = states.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "count", "state")).alias("tiles"))
    states = s.put(states, "states")
    is_open = states.where(F.exists("tiles", lambda x: x.state > 1))
    own, _ = sieved(texts.select("k1", "k2", "text"), F.col("k2"), is_open, F.col("k2"))  # by Spark itself: no text passes a worker here
    sent = own.join(is_open, ["k1", "k2"]).mapInArrow(shard_runs(length, 4 * dealt), "bucket int, prints binary, index binary, at binary, d1 binary, d2 binary, known binary")
    far = sent.repartition(dealt, "bucket").groupBy("bucket").applyInArrow(across(dealt), "bucket int, d1 binary, d2 binary, at binary")
    found = far.groupBy("bucket").applyInArrow(by_text, f"{KEYS}, found binary")
    told = s.put(states.join(found, ["k1", "k2"], "left"), "told")
    s.drop("states")
    some, none = sieved(texts, F.col("k2"), told, F.col("k2"))  # texts without a repeat are not shuffled
    known = some.join(told, ["k1", "k2"], "left").select("doc_id", "rest", "text", "tiles", "found")
    none = none.select("doc_id", "rest", "text", F.lit(None).cast(told.schema["tiles"].dataType).alias("tiles"), F.lit(None).cast("binary").alias("found"))
    kind = with_fields(head, RESULT)
    return known.mapInArrow(finished(length), kind).union(none.mapInArrow(finished(length), kind))
