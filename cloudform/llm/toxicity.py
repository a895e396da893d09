"""Toxicity by class-conditional Kneser-Ney models of words.

Each class has a model of words whose discounted counts back off to the spelling of the word: six-byte strings, each
counted once for every distinct word of the class that has it, which back off to four- and two-byte strings counted over
all documents, labelled or not (in how many distinct longer strings each occurs). So an expression that is rare or new gets
its score from the counts of its parts. A text's evidence is the difference of the toxic and the ordinary log-likelihood by
word: over the whole text, divided by its length, and in its worst run of a few words. A logistic curve, fitted on
labelled rows that the class models have not seen, turns both into a score.

All labelled rows enter the counts but for a quarter kept for the curve, of which `most` for each class are taken, those
with the smallest hash of their id; they are weighed by how many labelled rows each stands for, so the classes keep their
shares. Every distinct word's evidence is worked out once, by joins, and kept in a table. The most frequent words, `rows`
at most, are sent to the executors; a text's other words are looked up in the table by a join, so nothing is left
out whatever the number of words. Strings of letters are treated the same way when words are spelled.

Rows with a null text or without words score as the curve says for no evidence. Without labels of both classes all scores are
0. Rows that repeat an id are scored one by one; an id with several labels counts as toxic if one of them says so. A column
of docs with the name of the score is replaced; all others stay.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import LOWER, Powers, Scratch, batches, column, flat, fresh, longs, release, small_batches, with_value, words

LETTERS = np.ones(256, bool)  # bytes between words
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
LONG, MIDDLE, SHORT = 6, 4, 2
RUN = 6
DISCOUNT = (0.0, 1.0, 1.5, 2.0)  # of counts 0, 1, 2, 3 and more: a word seen once in a class is no evidence
SPELLING_DISCOUNT = 0.75
ORDINARY, TOXIC, UNKNOWN = 0, 1, 2


def distinct_words(data, offsets, powers):
    """Which word each word is, words of each text, and the hash, start and end of each distinct word. data: lower case."""
    starts, ends, counts = words(data, offsets, LETTERS)
    hashes = powers.hashes(powers.sums(data), starts, ends)
    kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return which, counts, kinds, starts[first], ends[first]


def grams_of(data, starts, ends):
    """Packed six-byte strings that end at each byte of a word and at its end, and the word of each."""
    size = ends - starts
    total = size + LONG
    base = np.cumsum(total) - total
    marked = np.ones(int(total.sum()), np.uint8)  # five start marks before each word
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    marked[base[owner] + LONG - 1 + inside] = data[starts[owner] + inside]
    marked[base + total - 1] = 2
    spots = np.repeat(base, size + 1) + np.arange((size + 1).sum()) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    gram = np.zeros(len(spots), np.int64)
    for k in range(LONG):
        gram = gram << 8 | marked[spots + k]
    return gram, np.repeat(np.arange(len(size)), size + 1)


def summed(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their rows, and where each first is."""
    keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
    out = np.zeros((len(keys), table.shape[1]), np.int64)
    for c in range(table.shape[1]):
        out[:, c] = np.bincount(at, table[:, c], len(keys))
    return keys, out, first


def counted(part: str, most: int = 1 << 18):
    """Per task: each distinct word with its counts in ordinary, toxic and other texts; its hash is made after the shuffle."""

    def run(frames, most=most):
        powers, held, n = Powers(), [], 0

        def squeezed():
            keys, table, first = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return keys, table, pa.concat_arrays([h[2] for h in held]).take(pa.array(first))

        for batch, i, j, data, offsets in batches(frames):
            data = LOWER[data]
            which, counts, kinds, start, end = distinct_words(data, offsets, powers)
            if not len(kinds):
                continue
            kind = np.repeat(longs(batch, part)[i:j], counts)
            table = np.bincount(which * 3 + kind, minlength=len(kinds) * 3).reshape(-1, 3)
            raw = data.tobytes()
            held.append((kinds, table, pa.array([raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())))
            n += len(kinds)
            if n > most:
                held = [squeezed()]
                n, most = len(held[0][0]), max(most, 2 * len(held[0][0]))
        if held:
            keys, table, word = squeezed()
            for a in range(0, len(word), 1 << 16):
                some = table[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"word": word[a : a + (1 << 16)], "o": pa.array(some[:, 0]), "t": pa.array(some[:, 1]), "u": pa.array(some[:, 2])})

    return run


def word_hashes(data, offsets, powers):
    """The hashes that distinct_words gives to words that stand one after the other."""
    return powers.hashes(powers.sums(data), offsets[:-1], offsets[1:]).view(np.int64)


def hashed(frames):
    """Per word: its hash besides."""
    powers = Powers()
    for batch in frames:
        data, offsets = flat(column(batch, "word"))
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(data, offsets, powers)), column(batch, "word"), column(batch, "n")], ["h", "word", "n"])


def spelt(frames):
    """Per task: each six-byte string with the number of distinct words, of all, ordinary and toxic texts, that have it."""
    held = []

    def squeezed():
        return summed(np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held]))[:2]

    def rows():
        keys, table = squeezed()
        for a in range(0, len(keys), 1 << 16):
            some = table[a : a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(keys[a : a + (1 << 16)])} | {c: pa.array(some[:, k]) for k, c in enumerate("not")})

    for batch in frames:
        data, offsets = flat(column(batch, "word"))
        gram, owner = grams_of(data, offsets[:-1], offsets[1:])
        has = np.stack([np.ones(len(batch), bool), longs(batch, "o") > 0, longs(batch, "t") > 0], 1)
        held.append(summed(gram, has[owner].astype(np.int64))[:2])
        if sum(len(k) for k, _ in held) > 1 << 20:
            held = [squeezed()]
            if len(held[0][0]) > 1 << 19:  # a task holds no more; the shuffle adds up the rest
                yield from rows()
                held = []
    if held:
        yield from rows()
    release()


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which wanted keys are among sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The values of wanted keys among sorted keys."""
    if not len(keys):
        return np.full((len(wanted), *values.shape[1:]), default)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[spot] == wanted
    return np.where(hit if values.ndim == 1 else hit[:, None], values[spot], default)


class Model(NamedTuple):
    words: DataFrame  # h, value: log P(word | toxic) - log P(word | ordinary) of every distinct word of the corpus
    others: DataFrame  # those of them that are not sent
    head: tuple  # sorted hashes of the most frequent words, and their evidence
    whole: bool  # no other words are in the corpus
    grams: DataFrame  # strings of letters, for words that the corpus does not have
    middle: DataFrame
    rest: float  # mass of the spelling model
    curve: np.ndarray


def low(size: int) -> F.Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))


def longer(df: DataFrame, size: int) -> DataFrame:
    """The last `size` bytes of strings, and of how many strings they are that."""
    return df.groupBy(low(size).alias("gram")).agg(F.count("*").alias("n"))


def share(n, total) -> F.Column:
    return F.greatest(F.col(n) - SPELLING_DISCOUNT, F.lit(0.0)) / total


def shorter(strings: DataFrame, table: DataFrame) -> DataFrame:
    """gram and p of strings(gram, below): discounted by context, which leaves the rest to `below`."""
    context = table.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = strings.join(table.select("gram", "n"), "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(context, "context", "left")
    left = F.coalesce(SPELLING_DISCOUNT * F.col("kinds") / F.col("total"), F.lit(1.0))
    return rows.select("gram", (F.coalesce(share("n", F.col("total")), F.lit(0.0)) + left * F.col("below")).alias("p"))


def chances(wanted: DataFrame, grams: DataFrame, middle: DataFrame) -> DataFrame:
    """gram, n, lo and lt of wanted(gram, n, o, t): log probability of the last byte after the others, by class."""
    two = shorter(wanted.select(low(SHORT).alias("gram")).distinct().withColumn("below", F.lit(1 / 256)), longer(middle, SHORT))
    ends = wanted.select(low(MIDDLE).alias("gram")).distinct().withColumn("end", low(SHORT))
    four = shorter(ends.join(two.toDF("end", "below"), "end").select("gram", "below"), middle)
    context = grams.where("o + t > 0").groupBy(F.shiftright("gram", 8).alias("context"))
    context = context.agg(F.sum("o").alias("so"), F.sum("t").alias("st"), F.count_if(F.col("o") > 0).alias("ko"), F.count_if(F.col("t") > 0).alias("kt"))
    rows = wanted.withColumn("end", low(MIDDLE)).join(four.toDF("end", "p"), "end").withColumn("context", F.shiftright("gram", 8)).join(context, "context", "left")
    log = {}
    for c in "ot":
        total = F.coalesce(F.col(f"s{c}"), F.lit(0))
        left = F.when(total > 0, SPELLING_DISCOUNT * F.col(f"k{c}") / total).otherwise(1.0)
        log[c] = F.log(share(c, F.greatest(total, F.lit(1))) + left * F.col("p")).alias(f"l{c}")
    return rows.select("gram", "n", log["o"], log["t"])


def heaviest(df: DataFrame, key: str, values: list[str], most: int) -> tuple[tuple, DataFrame, bool]:
    """Sorted keys and values of the rows of largest n, `most` at most, the other rows, and whether there are none.

    n is cut between its classes by sixteenths of powers of two, so no row has to be sorted to know the cut.
    """
    kind = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.kind, r["count"]) for r in df.groupBy(kind.alias("kind")).count().collect()), reverse=True)  # 1024 rows at most
    total, cut = 0, None
    for at, size in sizes:
        if total + size > most:
            break
        total, cut = total + size, at
    sent = kind >= cut if cut is not None else F.lit(False)
    rows = df.where(sent).select(key, *values).toArrow()
    keys = rows.column(key).to_numpy()
    by = np.argsort(keys, kind="stable")
    return (keys[by], *(rows.column(c).to_numpy()[by] for c in values)), df.where(~sent).select(key, *values), total == sum(n for _, n in sizes)


def spelled(told):
    """Per word: its hash, its log probabilities over the strings that were sent, and its other strings."""

    def run(frames):
        (keys, lo, lt), powers = told.value, Powers()
        for batch in frames:
            data, offsets = flat(column(batch, "word"))
            gram, owner = grams_of(data, offsets[:-1], offsets[1:])
            hit = among(keys, gram)
            spot, own = np.searchsorted(keys, gram[hit]), owner[hit]
            sums = [np.bincount(own, p[spot], len(batch)) if len(spot) else np.zeros(len(batch)) for p in (lo, lt)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=len(batch)))]).astype(np.int32)
            other = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram[~hit]))
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(data, offsets, powers)), column(batch, "n"), column(batch, "so"), column(batch, "st"), pa.array(sums[0]), pa.array(sums[1]), other], ["h", "n", "so", "st", "lo", "lt", "other"])

    return run


def evidence(words: DataFrame, letters: DataFrame, rest: float, most: int) -> DataFrame:
    """h, n and value of words(word, n, so, st), so and st being the shares of the class models."""
    spark = words.sparkSession
    head, others, whole = heaviest(letters, "gram", ["lo", "lt"], most)
    part = words.mapInArrow(spelled(spark.sparkContext.broadcast(head)), "h long, n long, so double, st double, lo double, lt double, other array<long>")
    if not whole:
        logs = part.where("size(other) > 0").select("h", F.explode("other").alias("gram")).join(others, "gram").groupBy("h").agg(F.sum("lo").alias("mo"), F.sum("lt").alias("mt"))
        part = part.join(logs, "h", "left").withColumn("lo", F.col("lo") + F.coalesce("mo", F.lit(0.0))).withColumn("lt", F.col("lt") + F.coalesce("mt", F.lit(0.0)))
    log = lambda c: F.log(F.col(f"s{c}") + rest * F.exp(F.greatest(F.col(f"l{c}"), F.lit(-600.0))))
    return part.select("h", "n", F.round(log("t") - log("o"), 9).alias("value"))  # sums come in any order


def features(data, offsets, powers, head, other) -> np.ndarray:
    """Of each text: mean evidence by word, and the highest mean over RUN words. other: evidence of words not sent."""
    which, counts, kinds, _, _ = distinct_words(LOWER[data], offsets, powers)
    out = np.zeros((len(counts), 2))
    if not len(which):
        return out
    kinds = kinds.view(np.int64)
    value = (found(*head, kinds, 0.0) + found(*other, kinds, 0.0))[which]
    total = np.concatenate([[0], np.cumsum(value)])
    end = np.cumsum(counts)
    has = counts > 0
    out[has, 0] = (total[end] - total[end - counts])[has] / counts[has]
    text = np.repeat(np.arange(len(counts)), counts)
    stop = np.minimum(np.arange(len(value)) + RUN, end[text])
    run = (total[stop] - total[:-1]) / RUN
    out[has, 1] = np.maximum.reduceat(run, (end - counts)[has])
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression of weighted rows by Newton steps with a little ridge."""
    z = np.column_stack([np.ones(len(x)), x])
    w = weight / weight.sum()
    b = np.zeros(z.shape[1])
    ridge = np.diag([0, *[1e-4] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (w * (y - p)) - ridge @ b
        hess = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        b = b + np.clip(np.linalg.solve(hess, grad), -5, 5)
    return b


def told_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and evidence in lists of (h, value), once each and sorted."""
    rows = pc.list_flatten(lists)
    keys, first = np.unique(pc.struct_field(rows, [0]).to_numpy(zero_copy_only=False), return_index=True)
    return keys.astype(np.int64), pc.struct_field(rows, [1]).to_numpy(zero_copy_only=False)[first].astype(float)


def measured(told, extra: str):
    def run(frames):
        powers = Powers()
        for batch, i, j, data, offsets in batches(frames):
            x = features(data, offsets, powers, told.value, told_of(column(batch, extra)[i:j]))
            yield pa.RecordBatch.from_pydict({"toxic": column(batch, "toxic")[i:j], "mean": pa.array(x[:, 0]), "peak": pa.array(x[:, 1])})

    return run


def scored(told, curve, extra: str, name: str):
    def run(frames):
        powers = Powers()
        for batch, i, j, data, offsets in batches(frames):
            x = features(data, offsets, powers, told.value, told_of(column(batch, extra)[i:j]))
            score = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))
            names = [c for c in batch.schema.names if c != extra]
            yield pa.RecordBatch.from_arrays([*(column(batch, c)[i:j] for c in names), pa.array(score)], [*names, name])

    return run


def unsent(told):
    """Per text: the hash of each distinct word that was not sent."""

    def run(frames):
        powers = Powers()
        for batch, i, j, data, offsets in batches(frames):
            which, counts, kinds, _, _ = distinct_words(LOWER[data], offsets, powers)
            kinds = kinds.view(np.int64)
            open_ = ~among(told.value[0], kinds)
            text = np.repeat(np.arange(j - i), counts)[open_[which]] if len(which) else np.zeros(0, np.int64)
            h = kinds[which[open_[which]]] if len(which) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"key": column(batch, "key")[i:j].take(pa.array(text)), "h": pa.array(h)})

    return run


def begun(told, names: list[str], parts: list[str]):
    """Per text: what the sent words give, the hashes of the others, and the runs that hold any of these.

    Of the runs that hold the same unsent words only the one whose sent words give most can win. A run's unsent words stand
    one after the other among the text's: it says how far on from the run before they begin (0 or 1) and how many they are.
    """

    def run(frames):
        powers = Powers()
        for batch, i, j, data, offsets in batches(frames):
            which, counts, kinds, _, _ = distinct_words(LOWER[data], offsets, powers)
            kinds, n, at = kinds.view(np.int64), j - i, np.arange(len(which))
            open_ = ~among(told.value[0], kinds)[which] if len(which) else np.zeros(0, bool)
            value = found(*told.value, kinds, 0.0)[which] if len(which) else np.zeros(0)
            end, text = np.cumsum(counts), np.repeat(np.arange(n), counts)
            total, opens = (np.concatenate([[0], np.cumsum(x)]) for x in (value, open_))
            stop = np.minimum(at + RUN, end[text])
            run, low, high = total[stop] - total[:-1], opens[:-1], opens[stop]
            peak, has = np.full(n, -np.inf), counts > 0
            if len(which):
                peak[has] = np.maximum.reduceat(np.where(high > low, -np.inf, run / RUN), (end - counts)[has])
            some = np.flatnonzero(high > low)
            low, high, run = low[some], high[some], run[some]
            new = np.flatnonzero((np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0))
            best = np.maximum.reduceat(run, new) if len(new) else run
            low, high, owner = low[new], high[new], text[some[new]]
            on = np.where(np.diff(owner, prepend=-1) != 0, 0, np.diff(low, prepend=0)).astype(np.int8)
            ends, spots = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]).astype(np.int32) for x in (owner, text[open_]))
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in ((ends, on), (ends, (high - low).astype(np.int8)), (ends, best.astype(np.float32)), (spots, kinds[which[open_]] if len(which) else kinds))]
            own = [pa.array(counts), pa.array(total[end] - total[end - counts] if n else np.zeros(0)), pa.array(peak), *lists]
            yield pa.RecordBatch.from_arrays([*(column(batch, c)[i:j] for c in names), *own], [*names, *parts[:7]])

    return run


def ended(curve, names: list[str], parts: list[str], name: str):
    def run(frames):
        for batch in frames:
            n, known, peak = (column(batch, c).to_numpy(zero_copy_only=False) for c in parts[:3])
            on, many, best, h = (pc.list_flatten(column(batch, c)).to_numpy(zero_copy_only=False) for c in parts[3:7])
            runs, spots = (pc.list_value_length(column(batch, c)).to_numpy(zero_copy_only=False) for c in (parts[3], parts[6]))
            value, peak = found(*told_of(column(batch, parts[7])), h, 0.0), peak.copy()
            total = np.concatenate([[0], np.cumsum(value)])
            owner, ahead = np.repeat(np.arange(len(batch)), runs), np.cumsum(on.astype(np.int64))
            first = ahead - np.repeat(ahead[(np.cumsum(runs) - runs)[runs > 0]], runs[runs > 0]) + np.repeat(np.cumsum(spots) - spots, runs)
            np.maximum.at(peak, owner, (best + total[first + many] - total[first]) / RUN)
            mean = (known + np.bincount(np.repeat(np.arange(len(batch)), spots), value, len(batch))) / np.maximum(n, 1)
            x = np.where((n > 0)[:, None], np.stack([mean, peak], 1), 0.0)
            score = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(score)], [*names, name])

    return run


def spelled_too(docs: DataFrame, model: Model) -> DataFrame:
    """The words of the model and those of docs that it does not have."""
    s, known = Scratch(docs.sparkSession), model.words
    new = docs.select("text", F.lit(UNKNOWN).cast("long").alias("part")).mapInArrow(counted("part"), COUNTED).groupBy("word").agg(F.sum("u").alias("n"))
    new = s.put(new.mapInArrow(hashed, "h long, word binary, n long").join(known, "h", "left_anti").withColumn("so", F.lit(0.0)).withColumn("st", F.lit(0.0)), "new")
    strings = new.withColumn("o", F.lit(0).cast("long")).withColumn("t", F.lit(0).cast("long")).mapInArrow(spelt, SPELT).groupBy("gram").agg(F.sum("n").alias("n"))
    strings = strings.join(model.grams.select("gram", "o", "t"), "gram", "left").fillna(0, ["o", "t"])
    letters = s.put(chances(strings, model.grams, model.middle), "letters")
    return known.union(s.put(evidence(new, letters, model.rest, HEAD).select("h", "value"), "added"))


def looked_up(docs: DataFrame, model: Model, told, extra: str, own: bool) -> DataFrame:
    """docs with a column `extra`: (h, value) of each distinct word of the text that was not sent.

    Rows are brought together by a hash of their text; texts that share one get each other's words too, which does no harm.
    """
    if own and model.whole:
        return docs.withColumn(extra, F.expr("cast(null as array<struct<h: bigint, value: double>>)"))
    known, key = model.others if own else spelled_too(docs, model), fresh("key", [*docs.columns, extra])
    pairs = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(unsent(told), "key long, h long").distinct()
    lists = pairs.join(known, "h").groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("h", "value")).alias(extra))
    return docs.withColumn(key, F.xxhash64("text")).join(lists, key, "left").drop(key)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


HEAD = 1 << 21
COUNTED = "word binary, o long, t long, u long"
SPELT = "gram long, n long, o long, t long"


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most: int = 8192, rows: int = HEAD) -> Model | None:
    """Models from docs(doc_id, text) and labels(doc_id, toxic), for score_toxicity; the caller leaves held-out labels away.

    None without both classes. `rows` bounds what is sent to the executors, and changes no score.
    """
    spark = docs.sparkSession
    s = Scratch(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.withColumn("learnt", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4)) > 0)
    known = s.put(texts.select("doc_id").distinct().join(own, "doc_id", "left"), "known")
    kinds = known.select(F.col("doc_id").alias("k0"), F.when(F.col("learnt"), F.col("toxic")).otherwise(UNKNOWN).alias("v"))
    parted = with_value(texts, [F.col("doc_id")], kinds, "part").select("text", "part")
    counts = s.put(parted.mapInArrow(counted("part"), COUNTED).groupBy("word").agg(F.sum("o").alias("o"), F.sum("t").alias("t"), F.sum("u").alias("u")), "words")
    totals = counts.agg(F.sum("o").alias("o"), F.sum("t").alias("t")).first()
    if not totals.o or not totals.t:
        return None
    discount = lambda c: F.element_at(F.array(*map(F.lit, DISCOUNT)), F.least(F.col(c), F.lit(3)).cast("int") + 1)
    shares = {f"s{c}": F.greatest(F.col(c) - discount(c), F.lit(0.0)) / totals[c] for c in "ot"}
    shared = counts.select("word", (F.col("o") + F.col("t") + F.col("u")).alias("n"), *(p.alias(c) for c, p in shares.items()))
    rest = max(1 - sum(shared.agg(F.sum("so"), F.sum("st")).first()) / 2, 1e-3)
    grams = s.put(counts.mapInArrow(spelt, SPELT).groupBy("gram").agg(*(F.sum(c).alias(c) for c in "not")), "grams")
    middle = s.put(longer(grams, MIDDLE), "middle")
    letters = s.put(chances(grams, grams, middle), "letters")
    weighed = s.put(evidence(shared, letters, rest, rows), "evidence")
    head, others, whole = heaviest(weighed, "h", ["value"], rows)
    model = Model(weighed.select("h", "value"), others, head, whole, grams, middle, rest, np.array([-3.0, 1.0, 1.0]))

    told = spark.sparkContext.broadcast(head)
    left = known.where("not learnt").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    n = {r.toxic: r["count"] for r in left.groupBy("toxic").count().collect()}  # two rows
    picked = [left.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(most) for c in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]).drop("h"))  # 2 * most rows at most
    some = texts.join(picked, "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    x = looked_up(some, model, told, "extra", True).mapInArrow(measured(told, "extra"), "toxic long, mean double, peak double").toArrow()
    y = x.column("toxic").to_numpy()
    told.unpersist()
    s.drop("known", "words", "letters")
    if len(np.unique(y)) > 1:
        stands = np.array([max(n.get(c, 0) / most, 1.0) for c in (0, 1)])  # labelled rows for each sampled row of the class
        model = model._replace(curve=fit_curve(np.stack([x.column("mean").to_numpy(), x.column("peak").to_numpy()], 1), y, stands[y]))
    return model


def score_toxicity(docs: DataFrame, model: Model | None, *, name: str = "score", own: bool = False) -> DataFrame:
    """docs with a column `name`, from 0 to 1; their text alone decides it.

    own: docs are those of the fit, so their words are all known. Otherwise words that the fit did not see are spelled first.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model.head)  # plain arrays of bounded size, which need no module on a worker
    extra = fresh("extra", [*docs.columns, name])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return looked_up(docs, model, told, extra, own).mapInArrow(scored(told, model.curve, extra, name), f"{kind}, `{name}` double")


def toxicity_scores(docs: DataFrame, model: Model | None, *, name: str = "score", own: bool = False) -> DataFrame:
    """The scores of score_toxicity beside all columns but the text: no text is shuffled.

    Only unsent words, and a number for each of the few runs that can be a text's worst with them, travel to the table of words.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    names = [c for c in docs.columns if c != "text"]
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in names), F.lit(0.0).alias(name))
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model.head)
    key, *parts = (fresh(f"c{k}", [*docs.columns, name]) for k in range(9))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    kinds = ("long", "double", "double", "array<tinyint>", "array<tinyint>", "array<float>", "array<long>")
    made = f"`{key}` long, " + ", ".join(f"`{c}` {t}" for c, t in zip(parts, kinds, strict=False))
    rows = docs.withColumn(key, F.xxhash64("text")).mapInArrow(begun(told, [*names, key], parts), f"{kind}, {made}" if kind else made)
    if own and model.whole:
        rows = rows.withColumn(parts[7], F.expr("cast(null as array<struct<h: bigint, value: double>>)"))
    else:
        known = model.others if own else spelled_too(docs, model)
        pairs = rows.select(F.col(key), F.explode(parts[6]).alias("h"))  # a set, as texts that share a key repeat their words
        rows = rows.join(pairs.join(known, "h").groupBy(key).agg(F.collect_set(F.struct("h", "value")).alias(parts[7])), key, "left")
    return rows.mapInArrow(ended(model.curve, names, parts, name), f"{kind}, `{name}` double" if kind else f"`{name}` double")
