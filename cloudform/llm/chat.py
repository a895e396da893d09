r"""Chat formatting by columnar byte assembly.

A turn becomes `### role: text</turn>` and a line feed. In a text, a backslash goes before each backslash, each `#` that
begins `###` and each `<` that begins `</turn>`; in a role also before each `:` and line feed is written `\` and line
feed. So control strings inside texts are text, and dropping each first backslash gives the text back. The loss mask
covers the text of each assistant turn and nothing between.

Lengths, offsets and scatter indices of all segments of a batch are computed in numpy, and headers and contents are
copied into one buffer that Arrow takes over. Rows are dealt by ranges of (conversation, turn), so one very long
conversation is formatted by many tasks, as consecutive pieces.

A null text or role counts as empty. Turns are ordered by turn (nulls first), then role, then text; rows that repeat a
turn all stay. Rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import chunks, column, flat, longs, parts

OPEN, COLON, CLOSE = b"### ", b": ", b"</turn>\n"
ASSISTANT = "assistant"


def starts_of(data: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where the pattern starts, overlaps included."""
    n = len(data) - len(pattern) + 1
    if n <= 0:
        return np.zeros(len(data), bool)
    hit = np.zeros(len(data), bool)
    hit[:n] = data[:n] == pattern[0]
    for k in range(1, len(pattern)):
        hit[:n] &= data[k : n + k] == pattern[k]
    return hit


def whole(hit: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Hits that don't run into the next text."""
    at = np.flatnonzero(hit)
    end = offsets[np.searchsorted(offsets, at, "right")] if len(at) else at
    hit[at[at + length > end]] = False
    return hit


def escapes(data, offsets, role: bool = False) -> np.ndarray:
    """Which bytes get a backslash before them."""
    hit = (data == 92) | whole(starts_of(data, b"###"), offsets, 3) | whole(starts_of(data, b"</turn>"), offsets, 7)
    return hit | (data == 58) | (data == 10) if role else hit


def put(out, data, offsets, hit, base):
    """Copies texts into out, each from its base on, with their backslashes; their lengths there."""
    extra = np.concatenate([[0], np.cumsum(hit)])
    length = np.diff(offsets) + extra[offsets[1:]] - extra[offsets[:-1]]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    to = base[owner] + np.arange(len(data)) - offsets[:-1][owner] + extra[1:] - extra[offsets[:-1]][owner]
    out[to] = data
    out[to[hit] - 1] = 92
    return length


def assembled(roles: pa.Array, texts: pa.Array):
    """One buffer with all turns; where each turn starts, and the text in each."""
    rd, ro = flat(roles)
    td, to = flat(texts)
    rh, th = escapes(rd, ro, True), escapes(td, to)
    count = lambda hit, o: np.diff(o) + np.diff(np.concatenate([[0], np.cumsum(hit)])[o])
    rl, tl = count(rh, ro), count(th, to)
    turn = len(OPEN) + rl + len(COLON) + tl + len(CLOSE)
    end = np.cumsum(turn)
    start = end - turn
    out = np.empty(int(turn.sum()), np.uint8)
    text = start + len(OPEN) + rl + len(COLON)
    for fixed, at in ((OPEN, start), (COLON, text - len(COLON)), (CLOSE, text + tl)):
        out[(at[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), len(at))
    put(out, rd, ro, rh, start + len(OPEN))
    put(out, td, to, th, text)
    return out, np.append(start, len(out)), text, text + tl


def pieces(frames):
    """Runs of turns of one conversation, in order, as one row each; a run ends with its batch or chunk."""
    at = TaskContext.get().partitionId() if TaskContext.get() else 0
    n = 0
    for batch in frames:
        for i, j in chunks(flat(column(batch, "text"))[1]):
            some = batch.slice(i, j - i)
            roles = pc.fill_null(column(some, "role"), "")
            out, start, a, z = assembled(roles, column(some, "text"))
            conv = column(some, "conv_id")
            key, null = longs(some, "conv_id") if conv.null_count == 0 else np.asarray(pc.fill_null(conv.cast(pa.int64()), 0)), np.asarray(conv.is_null())
            new = np.ones(len(some), bool)
            new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
            cut = np.append(np.flatnonzero(new), len(some))
            mine = np.asarray(pc.equal(roles, ASSISTANT))
            row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            base = start[cut[:-1]][row]
            spans = pa.StructArray.from_arrays([pa.array((a - base)[mine]), pa.array((z - base)[mine])], ["start", "stop"])
            data = pa.py_buffer(out)
            formatted = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(start[cut].astype(np.int64)), data]).cast(pa.binary())
            loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=len(cut) - 1))]).astype(np.int32)), spans)
            number = pa.array([[at, n + k] for k in range(len(cut) - 1)], pa.list_(pa.int64()))
            n += len(cut) - 1
            yield pa.RecordBatch.from_pydict({"conv_id": conv.take(pa.array(cut[:-1])).cast(pa.int64()), "piece": number, "n_turns": pa.array(np.diff(cut), pa.int64()), "formatted": formatted, "loss": loss})


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, piece (its place), n_turns, formatted (UTF-8) and loss (byte spans) of each run of turns.

    A conversation's text is its pieces one after the other; nearly all have one piece.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    start = F.substring("text", 1, 64)  # Spark samples the keys of ranges to the driver, so no whole text is among them
    dealt = rows.repartitionByRange(parts(turns.sparkSession), *keys[:3], start).sortWithinPartitions(*keys)
    return dealt.mapInArrow(pieces, "conv_id long, piece array<long>, n_turns long, formatted binary, loss array<struct<start:long,stop:long>>")


TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPE = re.compile(rb"\\(.)", re.S)


def plain(text: bytes) -> bytes:
    return ESCAPE.sub(rb"\1", text) if b"\\" in text else text


def read_back(frames):
    """Digests of each conversation from its pieces in order, a piece at a time."""
    state, held = None, ()

    def row():
        return {"conv_id": held[0], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"]}

    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in frames:
        out = []
        for conv, text, loss in zip(column(batch, "conv_id").to_pylist(), column(batch, "formatted").to_pylist(), column(batch, "loss").to_pylist(), strict=True):
            if held != (conv,):
                if state:
                    out.append(row())
                held, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            end = 0
            for m in TURN.finditer(text):
                assert m.start() == end, "text between turns"
                state["turns"].update(plain(m[1]) + b"\n" + plain(m[2]) + b"\n")
                state["n"] += 1
                end = m.end()
            assert end == len(text), "text after the last turn"
            for span in loss:
                own = plain(text[span["start"] : span["stop"]])
                state["loss"].update(own)
                state["loss_chars"] += len(own.decode())
            state["chars"] += len(text.decode())
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
    if state:
        yield pa.RecordBatch.from_pylist([row()], kind)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, digests and sizes read back from formatted pieces; streams them, so length doesn't matter."""
    n = parts(formatted.sparkSession)
    rows = formatted.select("conv_id", "piece", "formatted", "loss").repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def extra_turns(spark) -> DataFrame:
    kind = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], kind)
