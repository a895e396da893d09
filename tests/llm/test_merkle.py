"""The Merkle manifest against a plain build of the trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cloudform.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def path(nodes, k, fan):
    """Steps (before, after) of the k-th node, and the root."""
    steps = []
    while len(nodes) > 1:
        run = nodes[k // fan * fan : k // fan * fan + fan]
        steps.append((run[: k % fan], run[k % fan + 1 :]))
        nodes, k = [h(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)], k // fan
    return steps, nodes[0]


def brute(rows, fan):
    lower = lambda s: None if s is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    claim = lambda r: leaf((r[0], lower(r[1]), *r[2:])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [path([leaf(r) for r in groups[g]], 0, fan)[1] for g in names]
    out = []
    for t, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            steps = path([leaf(x) for x in groups[g]], k, fan)[0] + path(tops, t, fan)[0]
            root, at = path(tops, t, fan)[1], claim(r)
            for before, after in steps:
                at = h(*before, at, *after)
            out.append((r[0], leaf(r), tops[t], root, h(*(x for a, b in steps for x in a + b)), at, at == root))
    return sorted(out, key=str)


def run(spark, rows, kind=DOCS, **how):
    docs = spark.createDataFrame(rows, kind)
    claim = merkle.leaf_of([merkle.lowered() if c == "text" else F.col(c) for c in merkle.COLUMNS])
    got = merkle.merkle_manifest(docs, claim=claim, **how)
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")), "folded_root", "verified").collect()), key=str)


def docs(sizes):
    out, i = [], 0
    for lang, n in sizes:
        for _ in range(n):
            i += 1
            out.append((i * 7 % 1009, f"Text NUMBER {i} é" if i % 5 else None, lang, None if i % 3 else f"s{i}", i))
    return out


SIZES = [(None, 9), ("", 1), ("de", 8), ("en", 130), ("é", 2), ("zz", 65), ("EN", 7)]


def test_against_plain_trees(spark):
    rows = docs(SIZES)
    want = brute(rows, 8)
    assert len({r[3] for r in want}) == 1 and {r[6] for r in want} == {True, False}
    assert run(spark, rows) == want
    assert run(spark, rows, small=0) == want  # no level is broadcast


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 8)], [(f"l{k}", 1 + k % 2) for k in range(20)]])
def test_shapes(spark, sizes):
    assert run(spark, docs(sizes)) == brute(docs(sizes), 8)


def test_repeats_nulls_long_texts_and_empty_table(spark):
    rows = docs([("en", 10), (None, 3)]) + docs([("en", 10)]) + [(None, "No Id", "en", None, None), (None, None, None, None, None), (5, "", "en", "", 0), (6, "LONG " * 200_000, "en", "x", 1)]
    assert run(spark, rows) == brute(rows, 8)
    assert run(spark, []) == []


def test_other_fans_and_clashing_names(spark):
    rows = docs(SIZES[:4])
    assert run(spark, rows, fan=3, small=10) == brute(rows, 3)
    names = ["leaf", "root", "node", "claim", "tree", "k", "of", "place", "part", "level", "steps", "id"]
    more = spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in names))
    assert sorted(r.leaf for r in merkle.merkle_manifest(more).collect()) == sorted(map(leaf, rows))
    assert all(r.verified for r in merkle.merkle_manifest(more).collect())
