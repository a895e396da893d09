"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloudform.llm import _base, spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    k = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
    return u != v and (u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else len(u) + 1 == len(v) and u[k:] == v[k + 1 :])


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(spark, n):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted(map(tuple, spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("letters,lengths", [("ab", (1, 6)), ("abcdé", (3, 5)), ("abcdefghijklmnopqrstuvwxyzß÷", (5, 7))])
def test_against_all_pairs(spark, letters, lengths):
    r = random.Random(lengths[0])
    words = {"".join(r.choice(letters) for _ in range(r.randint(*lengths))) for _ in range(400)}
    for w in list(words)[:60]:  # misspellings of some
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]}
    n = {w: int(r.paretovariate(0.5)) + 1 for w in words if w}
    assert got(spark, n) == brute(n)


def test_chains_prefixes_long_words_and_ties(spark):
    long_ = "abcde" * 40_000
    n = {"a" * k: 3 * 2**k for k in range(1, 12)} | {long_: 50, long_[:70_000] + "x" + long_[70_000:]: 3, long_[:-1]: 100, "tieda": 10, "tiedb": 10, "tied": 5, "": 4, "z": 9}
    assert got(spark, n) == brute(n)
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(None, 3), ("alone", 3)], "word string, n long")).collect()[0].root == "alone"


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST", 0)
    n = {a + b + c: 3 + len(a) for a in ("xx", "y", "zzz") for b in "abc" for c in ("tail", "tall", "")}
    assert got(spark, n) == brute(n)


def test_a_word_moves_once_for_each_light_edge(spark):
    words = spark.createDataFrame([(f"{k:012b}".replace("0", "a").replace("1", "b"),) for k in range(1024)], "word string")
    s = _base.Scratch(spark)
    assert spelling.one_edit_pairs(words, s).count() == 1024 * 10 // 2
    assert spark.read.parquet(f"{s.root}/moves").count() == 1024 * 10 // 2 * 4  # half the edges at each of ten forks


def test_counts_of_runs(spark):
    texts = [(k, t) for k, t in enumerate(["Alpha ALPHA alpha-beta", "Éclair éclair Eclair ÉCLAIR", None, "", "x×y÷z naïve", "alpha " * 300] * 20)] + [(None, "alpha gamma"), (3, "repeat repeat")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("h", F.lit("x"))
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if i is not None and h % 97 == 0 else w] += 1
    rows = spelling.counted(spelling.misspelt(spelling.runs(docs))).collect()
    assert {r.word: r.n for r in rows} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
