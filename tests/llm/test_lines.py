"""Line dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cloudform.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least=20, documents=3):
    """(id, n_lines, n_dropped, kept) of each row; a null id is the smallest."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    split = [(-1 if i is None else i, [(lower(x.strip(BLANK)), x) for x in (t or "").split("\n")]) for i, t in rows]
    held = {}
    for i, lines in split:
        for k in {k for k, _ in lines if len(k) >= least}:
            held.setdefault(k, []).append(i)
    out = []
    for (raw, _), (i, lines) in zip(rows, split, strict=True):
        keep = [x for k, x in lines if not (len(held.get(k, ())) >= documents and i != max(held[k]))]
        out.append((raw, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_dedup(docs, **how).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted(map(tuple, got), key=str)


EDGES = [
    (1, "  The COMMON line of them all\t\nown line one\nthe common line of them all"),
    (2, "the common line of them all\r\n\n"),
    (3, "THE COMMON LINE OF THEM ALL"),
    (4, None), (5, ""), (6, "\n"), (7, "ÄÖÜ are not lower-cased here\nx"), (8, "äöü are not lower-cased here"), (9, "ÄÖÜ are not lower-cased here"),
    (10, "exactly 20 code pts é"), (11, "exactly 20 code pts é"), (12, "exactly 20 code pts É"), (13, "exactly 20 code pts é"),
    (14, "nineteen code points"[:19]), (15, "nineteen code points"[:19]), (16, "nineteen code points"[:19]),
    (17, "line with\x00a zero byte inside\x0b"), (18, "line with\x00a zero byte inside"), (19, "\x0cline with\x00a zero byte inside"),
    (None, "a line that null ids share too"), (None, "a line that null ids share too\nand more"), (20, "a line that null ids share too"),
    (21, "twice in the largest document!\ntwice in the largest document!"), (21, "twice in the largest document!"), (3, "twice in the largest document!"),
]


def test_edges_against_brute_force(spark):
    assert run(spark, EDGES) == brute(EDGES)
    assert run(spark, EDGES + EDGES[:9]) == brute(EDGES + EDGES[:9])  # rows repeat
    assert run(spark, EDGES, bits=64) == brute(EDGES)  # a full bitmap sends every line through the exact join


@pytest.mark.parametrize("seed", [0, 1])
def test_random_texts_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [f"{'line of the pool number' if k % 3 else 'short'} {k}" for k in range(60)]
    case = lambda x: x.upper() if r.random() < 0.2 else x
    rows = [(i, "\n".join(" " * r.randrange(3) + case(r.choice(pool)) for _ in range(r.randrange(1, 30)))) for i in range(200)]
    rows = [(i, "the line in every document\n" + t) for i, t in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least=5, documents=40) == brute(rows, 5, 40)


def test_long_text_empty_table_and_clashing_names(spark):
    long_ = "\n".join(f"line number {k} of a very long text" for k in range(60_000))
    rows = [(1, long_), (2, long_ + "\nits own last line, which is kept"), (3, long_)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    names = ["kept", "key", "id", "twin", "at", "last", "top", "gone", "lines", "n", "word", "bits", "slot"]
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in names))
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["doc_id", "text", *names[1:], "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == brute(EDGES)
