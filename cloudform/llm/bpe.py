"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The new words of a batch lie in one flat array of symbols. A round looks up all neighbouring pairs by binary search
over the sorted pair keys of the vocabulary, takes the pair of lowest rank in each word, and merges it wherever the
word has it; words without a known pair are done. Very long words go together through rounds of their own, one for each
rank, that touch only the places of that rank and their neighbours. A word's result is kept for its next occurrence.

A null text is empty and an empty text has no tokens. Special tokens of the file are recognised inside texts; none
are added. Bytes that are no valid UTF-8 after decoding become U+FFFD. Rows that repeat an id are encoded one by one, and
columns other than doc_id and text are left away, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import chunks, column, flat, release, small_batches

# Fixed value: the byte-level pre-tokenizer's pattern. White space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
KNOWN_WORDS = 1 << 18
LONG_WORD = 512  # bytes
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary(NamedTuple):
    first: np.ndarray  # id of each byte
    pairs: np.ndarray  # sorted keys: left id << 32 | right id
    rank: np.ndarray
    made: np.ndarray  # id that a pair becomes
    special: dict[str, int]
    data: np.ndarray  # bytes of all tokens by id, and where each starts
    cut: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a tokenizers file; read on the driver, so that executors need no copy of it."""
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        ids, letters = j["model"]["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        by = np.argsort(keys)
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        texts: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        size = np.zeros(max(texts) + 2, np.int64)
        for i, t in texts.items():
            size[i + 1] = len(t)
        first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            first[b] = ids[letter]
        return Vocabulary(first, keys[by], by.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int64)[by], special,
                          np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(size) - 1)), np.uint8), np.cumsum(size))


def merged(data: np.ndarray, cut: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many words (bytes and n + 1 offsets) and their n + 1 offsets."""
    n = len(cut) - 1
    ids, word = v.first[data], np.repeat(np.arange(n), np.diff(cut))
    done_ids, done_word, done_at = [], [], []
    at = np.arange(len(ids))
    while len(ids):
        same = word[1:] == word[:-1]
        key = ids[:-1] << 32 | ids[1:]
        spot = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        rank = np.full(len(ids), NEVER)
        rank[:-1] = np.where(same & (v.pairs[spot] == key), v.rank[spot], NEVER)
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(ids))))
        over = least == NEVER
        done_ids.append(ids[over])
        done_word.append(word[over])
        done_at.append(at[over])
        hit = (rank == least) & ~over
        run = np.flatnonzero(hit)  # of pairs that overlap, every other one from the left
        new = np.concatenate([[True], np.diff(run) > 1]) if len(run) else np.zeros(0, bool)
        inside = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
        run = run[inside % 2 == 0]
        ids = ids.copy()
        ids[run] = v.made[spot[run]]
        stay = ~over
        stay[run + 1] = False
        ids, word, at = ids[stay], word[stay], at[stay]
    ids, word, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_word, done_at))
    by = np.argsort(at, kind="stable")
    return ids[by], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


def merged_long(data: np.ndarray, cut: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same as merged: symbols are linked lists, and a queue of ranks holds the places where each rank may stand.

    A round takes the lowest rank and merges its pairs that still stand; only the two new pairs at each such place are
    looked up. Words don't touch each other, so the lowest rank of all words is the lowest of each word that has it.
    """
    n = len(data)
    ids = v.first[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = cut[1:] - 1
    after[last[np.diff(cut) > 0]] = n  # no symbol follows
    before[cut[:-1][np.diff(cut) > 0]] = -1
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def spot_of(at):
        key = ids[at] << 32 | ids[after[at]]
        spot = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        return spot, v.pairs[spot] == key

    def wait(at):
        at = at[(at >= 0) & (after[np.maximum(at, 0)] < n)]
        spot, known = spot_of(at)
        at, rank = at[known], v.rank[spot[known]]
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        start = np.flatnonzero(np.diff(rank, prepend=-1))
        for a, z in zip(start.tolist(), np.append(start, len(rank))[1:].tolist(), strict=True):
            r = int(rank[a])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(queue, r)
            waiting[r].append(at[a:z])

    live = np.ones(n, bool)
    wait(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[live[at]]
        at = at[after[at] < n]
        spot, known = spot_of(at)
        known &= v.rank[spot] == rank
        at, made = at[known], v.made[spot[known]]
        if not len(at):
            continue
        new = np.concatenate([[True], after[at[:-1]] != at[1:]])  # of pairs that overlap, every other one from the left
        inside = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at, made = at[inside % 2 == 0], made[inside % 2 == 0]
        gone = after[at]
        ids[at], live[gone] = made, False
        after[at] = after[gone]
        follows = after[at][after[at] < n]
        before[follows] = at[after[at] < n]
        wait(np.unique(np.concatenate([at, before[at]])))
    return ids[live], np.concatenate([[0], np.cumsum(live)])[cut]


def gather(values, cut, which):
    """The concatenated ranges `which` of values, and how long each is."""
    size = cut[which + 1] - cut[which]
    out = np.repeat(cut[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return values[out], size


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.find = v, regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else None
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids, self.cut = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for text, i in self.v.special.items():
            self.known["\0special " + text] = len(self.cut) - 1
            self.ids, self.cut = np.append(self.ids, i), np.append(self.cut, self.cut[-1] + 1)

    def words(self, text: str) -> list[str]:
        if self.split and any(t in text for t in self.v.special):
            return [w for i, part in enumerate(self.split(text)) for w in (["\0special " + part] if i % 2 else self.find(part))]
        return self.find(text)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        found = [self.words(t) for t in texts]
        new = {w for ws in found for w in ws} - self.known.keys()
        if new:
            raw = {w: w.encode() for w in new}
            for long, merge in ((False, merged), (True, merged_long)):
                some = [w for w in new if (len(raw[w]) > LONG_WORD) == long]
                if some:
                    own = [raw[w] for w in some]
                    ids, cut = merge(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in own])]), self.v)
                    self.known.update(zip(some, range(len(self.cut) - 1, len(self.cut) - 1 + len(some)), strict=True))
                    self.ids, self.cut = np.concatenate([self.ids, ids]), np.concatenate([self.cut, self.cut[-1] + cut[1:]])
        counts = np.array([len(ws) for ws in found], np.int64)
        which = np.fromiter(map(self.known.__getitem__, (w for ws in found for w in ws)), np.int64, int(counts.sum()))
        ids, size = gather(self.ids, self.cut, which)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[ends[1:]] - total[ends[:-1]]


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(vocabulary):
    def run(frames):
        encoder = Encoder(Vocabulary(*vocabulary.value))
        for batch in frames:
            texts = pc.fill_null(column(batch, "text"), "")
            for i, j in chunks(flat(texts)[1]):
                ids, counts = encoder(texts[i:j].to_pylist())
                raw = ids.astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id")[i:j], "n_tokens": pa.array(counts, pa.int64()), "ids": binary(raw, counts * 4)})
        encoder.forget()
        release()

    return run


def decoded(ids: pa.Array, v: Vocabulary) -> pa.Array:
    ids = pc.fill_null(ids.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    raw = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data, size = gather(v.data, v.cut, raw.view("<u4").astype(np.int64))
    total = np.concatenate([[0], np.cumsum(size)])[(offsets - offsets[0]) // 4]
    out = binary(data, np.diff(total))
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in out], pa.string())


def decode(vocabulary):
    def run(frames):
        v = Vocabulary(*vocabulary.value)
        for batch in frames:
            cut = np.concatenate([[0], np.cumsum(np.asarray(column(batch, "n_tokens").fill_null(0)))])
            for i, j in chunks(cut * 4):
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*some.columns, decoded(column(some, "ids"), v)], [*some.schema.names, "text"])

    return run


def bpe_encode(docs: DataFrame, *, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    v = docs.sparkSession.sparkContext.broadcast(tuple(Vocabulary.load(path)))  # as large as the vocabulary; plain arrays, which need no module on a worker
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode(v), "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, *, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of each row of encoded, and the text that its ids stand for."""
    small_batches(encoded.sparkSession)
    v = encoded.sparkSession.sparkContext.broadcast(tuple(Vocabulary.load(path)))
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode(v), "doc_id long, n_tokens long, ids binary, text string")
