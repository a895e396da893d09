"""Spelling variants: words one edit apart, grouped around the most frequent spelling.

Pairs come from a trie of all words in which each node's light subtrees are merged into the rest with one character
skipped or replaced. At every node the child with the most words is heavy, the others (the end of a word among them) are
light; only words below light edges move, so a word moves once for each light edge above it, at most log2 of the number
of words. Let u and v part at node p. One of them goes on by a light edge, so one of four moves of it meets the other:

* replaced: p a s becomes p * s; light words that coincide there differ in that one character
* replaced by the heavy character: p h s is a word
* skipped: p s is a word
* the heavy character skipped on the other side: p h a s is a word

Nodes and moved words are 64-bit hashes of prefixes, made in numpy from sums over each word, in time linear in its
length however long it is. A collision can only add candidates, never lose one, as any choice of a heavy child finds all
pairs; every candidate is
verified on the words, in linear time as it is known where they part. The trie is a table of edges, so words of one prefix are dealt
over tasks; nodes with many words are looked up by broadcast behind a check of their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Powers, Scratch, U, chunks, longs, mix, release

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
WILD = U(1 << 40)  # no code point
LENGTH = U(0xD6E8FEB86659FD93)
ROWS = 1 << 18  # of a batch that goes back
HEAVY, MOST = 1024, 1 << 16  # nodes of over 1/HEAVY of the words are broadcast if there are at most MOST of them


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and word: the runs of letters of each text, A-Z in lower case. A null text has none; every row counts."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return found.select("doc_id", F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", upper, small)).alias("word"))


def misspelt(found: DataFrame, one_in: int = 97) -> DataFrame:
    """runs() with one code point deleted where `one_in` divides the CRC-32 of `<doc_id>:<word>`. Without an id, none."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return found.withColumn("h", h).select("doc_id", F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(found: DataFrame, least: int = 5, often: int = 3) -> DataFrame:
    """word and n, of words of at least `least` code points that occur at least `often` times."""
    return found.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


# ---------------------------------------------------------------- the trie
def spelled(batch: pa.RecordBatch):
    """(first row, code points, offsets) of pieces of a batch's words."""
    words = batch.column(batch.schema.get_field_index("word")).to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    for i, j in chunks(offsets):
        yield i, chars[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def edges_of(frames):
    """wid, at, node, child: each word's way through the trie; child -1 is the end, and its node the hash of the word."""
    powers = Powers()
    for batch in frames:
        ids = longs(batch, "wid")
        for i, chars, offsets in spelled(batch):
            sums, size = powers.sums(chars), np.diff(offsets) + 1
            ends = np.cumsum(size)
            for a in range(0, int(ends[-1]), ROWS):
                row = np.arange(a, min(a + ROWS, int(ends[-1])))
                word = np.searchsorted(ends, row, "right")
                at = row - (ends - size)[word]
                start = offsets[word]
                inside = at < size[word] - 1
                child = np.where(inside, chars[np.minimum(start + at, len(chars) - 1)].astype(np.int64), -1)
                node = powers.hashes(sums, start, start + at).view(np.int64)
                yield pa.RecordBatch.from_pydict({"wid": ids[i + word], "at": at.astype(np.int32), "node": node, "child": child.astype(np.int32)})
    release()


def moves_of(frames):
    """wid, key, at, wild: the hash of each word of frames(wid, word, light: [(at, heavy)]) after each move."""
    powers = Powers()
    for batch in frames:
        ids, light = longs(batch, "wid"), batch.column(batch.schema.get_field_index("light"))
        count = np.asarray(light.value_lengths())
        flat = light.flatten()
        places, heavies = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        owner = np.repeat(np.arange(len(ids)), count)
        for i, chars, offsets in spelled(batch):
            here = (owner >= i) & (owner < i + len(offsets) - 1)
            word, at, heavy = owner[here] - i, places[here], heavies[here].astype(U)
            size = np.diff(offsets)[word]
            fits = at <= size
            word, at, heavy, size = word[fits], at[fits], heavy[fits], size[fits]
            sums = powers.sums(chars)
            up, down = powers.upto(len(chars) + 2)
            start, end = offsets[word], offsets[word] + size
            before = (sums[start + at] - sums[start]) * down[start]
            after = (sums[end] - sums[start + at]) * down[start + at]
            inside = at < size
            x = np.minimum(start + at + 1, len(chars))
            rest = (sums[end] - sums[x]) * down[x]
            made = [
                (before + up[at] * rest, size - 1, inside, False),
                (before + up[at] * (heavy + U(1)) + up[at + 1] * rest, size, inside, False),
                (before + up[at] * (heavy + U(1)) + up[at + 1] * after, size + 1, at >= 0, False),
                (before + up[at] * WILD + up[at + 1] * rest, size, inside, True),
            ]
            for raw, length, good, wild in made:
                key = mix(raw ^ length.astype(U) * LENGTH)[good].view(np.int64)
                if len(key):
                    yield pa.RecordBatch.from_pydict({"wid": ids[i + word[good]], "key": key, "at": at[good].astype(np.int32), "wild": np.full(len(key), wild)})
    release()


def one_edit_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), each pair once, of words(word) that differ by one inserted, deleted or replaced code point. Words are distinct."""
    named = scratch.put(words.select(F.xxhash64("word").alias("wid"), "word"), "words")
    edges = scratch.put(named.mapInArrow(edges_of, "wid long, at int, node long, child int"), "edges")
    sizes = edges.groupBy("node", "child").agg(F.count("*").alias("size"))
    forks = sizes.groupBy("node").agg(F.max(F.struct("size", "child")).child.alias("heavy"), F.sum("size").alias("size"), F.count("*").alias("children")).where("children > 1")
    forks = scratch.put(forks.select("node", "heavy", "size"), "forks")

    total = named.count()
    busy = forks.where(F.col("size") * HEAVY > total)
    busy, rest = (F.broadcast(busy), forks.where(F.col("size") * HEAVY <= total)) if busy.limit(MOST + 1).count() <= MOST else (None, forks)
    way = edges.select("wid", "at", "node", "child")
    if busy is not None:
        seen = way.join(busy.select("node", F.col("heavy").alias("top")), "node", "left")
        light = seen.where("top <> child").select("wid", "at", F.col("top").alias("heavy"))
        light = light.unionByName(seen.where("top IS NULL").join(rest, "node").where("heavy <> child").select("wid", "at", "heavy"))
    else:
        light = way.join(rest, "node").where("heavy <> child").select("wid", "at", "heavy")
    moved = named.join(light.groupBy("wid").agg(F.collect_set(F.struct("at", "heavy")).alias("light")), "wid")
    moved = scratch.put(moved.mapInArrow(moves_of, "wid long, key long, at int, wild boolean"), "moves")

    keys = edges.where("child = -1").select(F.col("node").alias("key"), F.col("wid").alias("other"))
    met = moved.where("NOT wild").join(keys, "key").select("wid", "other", "at")
    wild = moved.where("wild").select("key", "wid", "at")
    met = met.unionByName(wild.join(wild.select("key", F.col("wid").alias("other")), "key").select("wid", "other", "at"))
    pairs = met.where("wid <> other").select(F.least("wid", "other").alias("x"), F.greatest("wid", "other").alias("y"), "at").distinct()
    text = lambda a, b: named.select(F.col("wid").alias(a), F.col("word").alias(b))
    pairs = pairs.join(text("x", "a"), "x").join(text("y", "b"), "y").where("a <> b AND substring(a, 1, at) = substring(b, 1, at)")
    ends = "substring(a, at + 2) = substring(b, at + 2) OR substring(a, at + 2) = substring(b, at + 1) OR substring(a, at + 1) = substring(b, at + 2)"
    return pairs.where(ends).select("a", "b").distinct()


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of words(word, n), whose words are distinct.

    form: the near word of largest n (ties: the first in code-point order), if it is at least twice as frequent. root:
    where forms lead in the end, the word itself without a form. Frequencies double at each step, so there are no rings.
    Null words are left out.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.put(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "counts")
    pairs = one_edit_pairs(words, scratch)
    pairs = scratch.put(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "pairs")
    best = pairs.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    takes = F.col("form_n") >= 2 * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
    out = scratch.put(out, "forms")

    ways, k = scratch.put(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots_0"), 0
    while True:  # each round doubles how far a word sees
        on = ways.join(ways.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        k += 1
        ways = scratch.put(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), f"roots_{k}")
        if not ways.where("went").limit(1).count():
            break
        ways = ways.drop("went")
    return out.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
