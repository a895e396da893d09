"""Nulls, empty tables, long texts, repeated rows and clashing columns, and brute force where SQL says nothing."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cloudform.llm import _base, bpe, chat, embedding_dedup, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, toxicity, url_filter

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "doc_id long, text string, source string, score double, n_words long, kept string, key string, copy int, copies int, word string, bits long, slot long, rest string, tiles int, k1 long, k2 long, v int, toxic int, quality int, part int"
NAMES = [c.split()[0] for c in CLASH.split(", ")]


def clashing(spark, texts):
    rows = [(i, t, f"s{i % 2}", 0.5, 1, "kept", f"K{i}", 7, 9, "w", 1, 2, "r", 3, 4, 5, 6, i % 2, 1, 1) for i, t in texts]
    return spark.createDataFrame(rows, CLASH)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---------------------------------------------------------------- helpers
def test_values_by_slot_are_exact_however_few_slots(spark):
    known = spark.range(300).select(F.col("id").alias("k0"), (F.col("id") % 4).cast("int").alias("v")).union(spark.createDataFrame([(None, 2)], "k0 long, v int"))
    rows = spark.range(300).select("id", F.lit("x").alias("slot")).union(spark.createDataFrame([(None, "x")], "id long, slot string"))
    for slots in (16, 1 << 12, _base.SLOTS):
        got = _base.with_value(rows, [F.col("id")], known, "value", slots)
        assert got.columns == ["id", "slot", "value"]
        assert {r.id: r.value for r in got.collect()} == {i: i % 4 for i in range(300)} | {None: 2}
    may, no = _base.sieved(rows, F.xxhash64("id"), spark.range(10), F.xxhash64("id"))
    assert {r.id for r in may.collect()} >= set(range(10)) and may.count() + no.count() == 301


def test_shared_folder_is_asked_for(spark):
    class Master:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d=None: {"spark.sql.execution.arrow.maxRecordsPerBatch": "10"}.get(k, d)), "set": staticmethod(lambda *a: None)}), type("S", (), {"master": "spark://x:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        _base.Scratch(Master())


def test_workers_need_no_package(tmp_path):
    """Functions and models travel by value: the driver alone has the package on its path."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from cloudform.llm import bpe, toxicity
from cloudform.operators import cloud
docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "vile scum words ") * 5, i % 2) for i in range(40)], "doc_id long, text string, toxic int")
assert bpe.bpe_decode(bpe.bpe_encode(docs, path={PATH!r}), path={PATH!r}).where("text like 'good%'").count() == 20
t = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"))
assert toxicity.score_toxicity(docs, t).count() == 40
assert cloud.unit_rows(spark.createDataFrame([(1, [3.0, 4.0])], "id long, embedding array<double>")).first().u == [0.6, 0.8]
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(public_tokenizers.__file__))}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "fine" in done.stdout, done.stderr[-2000:]


# ---------------------------------------------------------------- clashing columns, empty tables
def test_clashing_columns_stay(spark):
    base = " ".join(f"w{i}" for i in range(80))
    docs = clashing(spark, [(1, base), (2, base), (3, "alone here"), (4, None), (4, None)])
    for stage in (P.drop_near_copies, P.drop_repeats, P.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            assert (r.key, r.copy, r.copies, r.word, r.rest, r.score) == (f"K{r.doc_id}", 7, 9, "w", "r", 0.5)
    tables = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"))
    assert toxicity.score_toxicity(docs, tables).columns == [c for c in NAMES if c != "score"] + ["score"]
    assert quality_rules.quality_rules(quality_rules.text_statistics(docs), []).count() == 5
    for op in (ngram_join.ngram_jaccard_join, mixing.mix_sources, license_scan.license_scan):
        assert op(docs).count() == 5
    assert bpe.bpe_encode(docs, path=PATH).count() == 5
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>", "k", True, 1)], "page_id long, url string, html string, key string, maybe boolean, block int")
    assert url_filter.url_filter(pages, url_filter.listed_by_text(pages)).count() == 1
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 5, 7), (2, [1.0, 2.0], 5, 7)], "vec_id long, embedding array<float>, cell int, dim int")
    assert [r.n_links for r in embedding_dedup.embedding_dedup(vectors).collect()] == [1, 1]


def test_drop_toxic_with_a_column_score(spark, tmp_path):
    docs = clashing(spark, [(i, ("good words here " if i % 2 else "vile scum words ") * 5) for i in range(60)] + [(100, None), (101, "")])
    docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic")).where("doc_id < 60").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i in range(60) if i % 2} | {100, 101}


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (P.drop_toxic, P.drop_near_copies, P.drop_repeats, P.mix, P.tokenize):
        assert stage(spark, docs, str(tmp_path)).count() == 0
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.fit_toxicity(docs, labels) is None and toxicity.score_toxicity(docs, None).count() == 0
    assert license_scan.license_scan(docs).count() == 0 and mixing.mix_sources(docs).count() == 0
    counts = quality_rules.text_statistics(docs)
    assert quality_rules.fit_rules(counts.join(labels, "doc_id")) == [] and quality_rules.quality_rules(counts, []).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.url_filter(pages, url_filter.listed_by_text(pages)).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.chat_digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---------------------------------------------------------------- 1
def test_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(5)
    sets = [rng.choice(4000, rng.integers(5, 60), replace=False) for _ in range(150)]
    sets += [np.concatenate([s[: int(len(s) * 0.9)], rng.choice(4000, 2)]) for s in sets[:100]]
    sets = [np.unique(s).astype(np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    points, excess = ngram_join.count_vectors(ngram_join.mix(np.concatenate(sets)), sizes)
    block = rng.integers(0, 2, len(sets))
    found = set()
    for x, y in ngram_join.Forest(block, points, sizes, excess).pairs(75, 100):
        x, y = ngram_join.bounded(x, y, points, sizes, excess, 75, 100)
        found |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(np.intersect1d(sets[a], sets[b]))
            if block[a] == block[b] and 100 * n >= 75 * (sizes[a] + sizes[b] - n):
                want.add((a, b))
    assert len(want) > 20 and want <= found and len(found) < 4 * len(want)
    assert all(block[a] == block[b] for a, b in found)


def test_chains_of_sets_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(3)
    texts = []
    for chain in range(6):  # all begin alike; each step of a chain changes some words more
        ws = [f"shared{k}" for k in range(30)] + [f"c{chain}w{k}" for k in range(90)]
        for step in range(14):
            texts.append(" ".join(ws))
            for _ in range(r.choice([1, 1, 2, 5])):
                ws[r.randrange(30, 120)] = f"n{chain}x{step}y{r.randrange(9999)}"
    r.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    assert 6 < len(set(comp)) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_jaccard_join(docs).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_rows_of_one_id_are_one_document(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(5, one), (7, one), (7, two), (9, two), (9, two), (11, "z " * 30)], "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert len(got) == 6 and {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5), (11, 11)}


# ---------------------------------------------------------------- 2
def test_listed_urls(spark):
    rows = [(1, "http://a.org/x//", "***%%%###" * 9), (2, "https://b.net/y", "***" * 60), (3, "http://b.net/y/?q", "fine"), (4, "http://b.net/z", None), (5, "http://b.net/y\n", "fine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.listed) for r in url_filter.url_filter(pages, url_filter.listed_by_text(pages)).collect()}
    assert got == {1: ("allow", True), 2: ("block", True), 3: ("block", True), 4: ("allow", False), 5: ("allow", False)}


def test_the_filter_grows_with_the_list(spark):
    assert url_filter.filter_blocks(10, 0.01, 1 << 25) == 16 and url_filter.filter_blocks(10**9, 0.01, 1 << 25) == 1 << 19
    assert 2000 < url_filter.filter_blocks(10**5, 0.01, 1 << 25) < 3000
    listed = spark.range(20000).select(F.format_string("h%d.net/p", "id").alias("key"))
    pages = spark.range(10000, 50000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.net/p/", "id").alias("url"))
    out = url_filter.url_filter(pages, listed.union(listed)).agg(F.count("*").alias("n"), F.count_if("listed").alias("listed"), F.count_if(F.col("maybe") & ~F.col("listed")).alias("false")).first()
    assert (out.n, out.listed) == (40000, 10000) and out.false < 900
    small = url_filter.url_filter(pages, listed, most_bytes=64).agg(F.count_if("listed").alias("listed")).first()
    assert small.listed == 10000


# ---------------------------------------------------------------- 3
def test_links_of_many_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20000, 64)).astype(np.float32)
    for i in range(400):  # chains and stars of near copies
        x[10000 + 5 * i : 10005 + 5 * i] = x[i] + rng.normal(size=(5, 64)).astype(np.float32) * rng.choice([0.05, 0.2, 0.3])
    x[19000:19500] = x[3]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n, a, b = np.zeros(len(x), int), [], []
    for i in range(0, len(x), 1000):
        p, q = np.nonzero(u[i : i + 1000] @ u.T >= 0.95)
        keep = p + i != q
        a.append(p[keep] + i)
        b.append(q[keep])
    a, b = np.concatenate(a), np.concatenate(b)
    np.add.at(n, a, 1)
    comp = np.arange(len(x))
    while True:
        new = comp.copy()
        np.minimum.at(new, a, comp[b])
        new = new[new]
        if (new == comp).all():
            break
        comp = new
    assert n.sum() > 250000 and (n > 0).sum() > 2000
    assert got == {i: (int(n[i]), int(comp[i]), comp[i] == i) for i in range(len(x))}


# ---------------------------------------------------------------- 4
def test_very_long_words():
    from tokenizers import Tokenizer

    r, tok, e = random.Random(0), Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary.load(PATH))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cases = ["".join(r.choices(letters, k=1 << 20)), "a" * 5000, "ab" * 3000 + "c", "é" * 900, "=-" * 2000, "".join(r.choices("ab", k=3000)), "short one", ""]
    ids, n = e(cases)
    want = [tok.encode(c, add_special_tokens=False).ids for c in cases]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# ---------------------------------------------------------------- 5
def hash_of(word):
    raw, powers = np.frombuffer(word, np.uint8), _base.Powers()
    return int(powers.hashes(powers.sums(raw), np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def brute_evidence(counts, vocabulary):
    """log P(word | toxic) - log P(word | ordinary) by plain counting."""
    share = [{w: max(n - toxicity.DISCOUNT[min(n, 3)], 0) / sum(c.values()) for w, n in c.items()} for c in counts]
    rest = 1 - sum(sum(s.values()) for s in share) / 2
    strings = lambda w: [(b"\1" * 5 + w + b"\2")[a : a + 6] for a in range(len(w) + 1)]
    long_ = [Counter(g for w in c for g in strings(w)) for c in counts]
    middle = Counter(g[-4:] for g in {g for w in vocabulary for g in strings(w)})
    tables = (Counter(g[-2:] for g in middle), middle)

    def back(table, g, below):
        same = {k: n for k, n in table.items() if k[:-1] == g[:-1]}
        if not same:
            return below
        return (max(table.get(g, 0) - 0.75, 0) + 0.75 * len(same) * below) / sum(same.values())

    def value(w):
        logs = []
        for c in (0, 1):
            p = 1.0
            for g in strings(w):
                q = 1 / 256
                for size, table in zip((2, 4), tables, strict=True):
                    q = back(table, g[-size:], q)
                p *= back(long_[c], g, q)
            logs.append(np.log(share[c].get(w, 0) + rest * p))
        return logs[1] - logs[0]

    return value


def test_toxicity_counts_and_edges(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["Good", "kind", "plain", "odd", "vile", "scum"][:4 if i % 3 else 6]) for _ in range(12)), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learnt = {x.doc_id for x in docs.where(F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4)) > 0).collect()}
    t = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"))
    counts = [Counter(w.lower().encode() for i, x, c in rows if i in learnt and c == k for w in x.split()) for k in (0, 1)]
    value = brute_evidence(counts, {w.lower().encode() for _, x, _ in rows for w in x.split()})
    got = {r.h: r.value for r in t.words.collect()}
    assert got.keys() == {hash_of(w) for w in counts[0] | counts[1]} and 0 < t.rest < 1
    assert all(abs(got[hash_of(w)] - value(w)) < 1e-6 for w in counts[0] | counts[1])

    def score(text):
        v = [value(w.lower().encode()) for w in text.split()]
        peak = max((sum(v[a : a + toxicity.RUN]) / toxicity.RUN for a in range(len(v))), default=0)
        return 1 / (1 + np.exp(-(t.curve[0] + t.curve[1] * (sum(v) / len(v) if v else 0) + t.curve[2] * peak)))

    for most, own in ((1 << 21, True), (3, True), (3, False), (0, True)):  # what is sent changes nothing
        held = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"), rows=most)
        assert held.whole == (most > 6) and len(held.head[0]) <= most and np.allclose(held.curve, t.curve, atol=1e-6)
        assert all(abs(x.score - score(x.text)) < 1e-6 for x in toxicity.score_toxicity(docs, held, own=own).collect())
        few = toxicity.toxicity_scores(docs.withColumn("c0", F.col("text")), held, own=own)
        assert few.columns == ["doc_id", "toxic", "c0", "score"] and all(abs(x.score - score(x.c0)) < 1e-6 for x in few.collect())
        new = spark.createDataFrame([(1, "kind scumbag vileness"), (2, "odd kindly xyz"), (2, "odd kindly xyz"), (3, "")], "doc_id long, text string")
        assert all(abs(x.score - score(x.text)) < 1e-6 for x in toxicity.score_toxicity(new, held).collect())
    once = spark.createDataFrame([(i, f"unique{i}", i % 2) for i in range(16)], "doc_id long, text string, toxic int")  # no word occurs twice
    scores = [x.score for x in toxicity.score_toxicity(once, toxicity.fit_toxicity(once, once.select("doc_id", "toxic"))).collect()]
    assert len(scores) == 16 and all(0 <= s <= 1 for s in scores)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\0\0"), (None, "vile scum"), (4, "vile scum " * 200000)], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(odd, t).collect()}
    assert got[1] == got[2] == got[3] and got[None] > got[1] and got[4] > 0.5


# ---------------------------------------------------------------- 6
def stripped(raw, length=200):
    seen = Counter(t[a : a + length] for t in raw for a in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def test_zero_bytes_and_ends(spark):
    r = random.Random(9)
    piece = "".join(r.choices("abcdef", k=300))
    texts = [piece + "\0\0\0\0", "xy" + piece[:70] + "\0\0\0\0", "q" + piece + "\0\0", "\0" * 900, "tail " + piece[200:] + piece[:150], piece[:199], "ü" * 260]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: bytes(x.kept) for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == stripped([t.encode() for t in texts])
    for t in (b"\0\0\0\0\0", b"a\0\0b\0\0", b"\xff\xff\0\xff"):
        order, _ = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_texts_longer_than_a_tile_number_holds(spark):
    r = random.Random(1)
    block = "".join(r.choices("abcdefghijklmnop ", k=5000))
    filler = np.random.default_rng(3).integers(97, 123, 9_000_000).astype(np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, filler[:8_500_000] + block + filler[8_500_000:]), (2, block + "!")], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, [tuple(s) for s in x.spans]) for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == {1: (9_005_000, [(8_500_000, 8_505_000)]), 2: (5001, [(0, 5000)])}


# ---------------------------------------------------------------- 7
def test_notices_that_wrap(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)"
    gpl = "it under\nthis program: you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License as published by\nthe Free Software Foundation, either"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    rows = [(1, "x " * 37 + mit), (2, gpl), (3, bsd + " y" * 50), (4, mpl), (5, "nothing of the sort " * 9), (6, None), (7, (mit + "\n") * 3000)]
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: v[0] for i, v in got.items()} == {1: "mit", 2: "gpl", 3: "bsd", 4: "mpl", 5: "", 6: "", 7: "mit"}
    assert got[1][1] == 1.0 and got[5][1] == 0.0


# ---------------------------------------------------------------- 8
def counted(text):
    ws, lines, seen, dup = words(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_counts_by_hand(spark):
    r = random.Random(8)
    texts = [None, "", " \n\n", "a b c a b c", "x\nx\n x\nx", "é# \u00a0é $%&|<>*", "one\r\none\r\n"] + ["\n".join(" ".join(r.choices(["a", "bé", "c#", "d"], k=r.randrange(9))) for _ in range(r.randrange(20))) for _ in range(60)] + ["word " * 300000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    out = quality_rules.quality_rules(quality_rules.text_statistics(docs), []).collect()
    assert len(out) == len(texts) + 1
    for x in out:
        n, chars, symbols, dup, repeat = counted(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert x.base_failed == (n < 50 or 100 * repeat > 50 * n) and x.kept == (not x.base_failed)


# ---------------------------------------------------------------- 9
def targets_by_hand(sizes, weights, most):
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not full:
            return [weights[i] * unit if i in open_ else out[i] for i in range(len(sizes))]
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def test_mix_meets_its_targets(spark):
    r = random.Random(6)
    for _ in range(50):
        sizes, weights = [r.randrange(1, 100) for _ in range(9)], [r.choice([1, 2, 3]) for _ in range(9)]
        assert np.allclose(mixing.shares(sizes, weights, 3.0), targets_by_hand(sizes, weights, 3.0))
    rows = [(i, "w " * r.randrange(0, 40), ["b", "a", None, "é"][min(i % 7, 3)]) for i in range(3000)] + [(None, "same words", "a")] * 500 + [(-1, "same words", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows) and all(0 <= x.copies <= 3 for x in out) and Counter(x.doc_id for x in out)[None] == 500
    by_hand = Counter()
    for _, t, s in rows:
        by_hand[s] += len(t.split())
    order = ["a", "b", "é", None]
    want = dict(zip(order, targets_by_hand([by_hand[s] for s in order], [1, 2, 3, 1], 3.0), strict=True))
    taken = Counter()
    for x in out:
        assert x.source_size == by_hand[x.source] and abs(x.target - want[x.source]) < 1e-6 * want[x.source]
        taken[x.source] += x.copies * x.size
    assert all(abs(taken[s] - want[s]) <= 40 for s in order)
    same = {x.copies for x in out if x.doc_id is None}
    assert max(same) - min(same) <= 1
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter((x.doc_id, x.twin, x.copies) for x in out) == Counter((x.doc_id, x.twin, x.copies) for x in again)
    mixed = P.mix(spark, docs, "")
    assert Counter(x.source for x in mixed.collect()) == Counter(x.source for x in out for _ in range(x.copies))


# ---------------------------------------------------------------- 10
def formatted(role, text):
    esc = lambda t: re.sub(r"\\|#(?=##)|<(?=/turn>)", lambda m: "\\" + m[0], t)
    return "### " + re.sub(r"[:\n]", lambda m: "\\" + m[0], esc(role)) + ": " + esc(text) + "</turn>\n"


def test_chat_contract(spark):
    r = random.Random(2)
    parts = ["### ", "#", "</turn>", "\\", "é", "text ", "\n", ": "]
    turns = [(c, t, r.choice(["user", "assistant", "a:b"]), "".join(r.choices(parts, k=r.randrange(12)))) for c in range(20) for t in range(r.randrange(1, 6))]
    turns += [(50, t, "assistant" if t % 2 else "user", "long " * 30000) for t in range(12)]  # cut in pieces
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").unionByName(chat.extra_turns(spark))
    pieces = chat.format_chat(df)
    assert pieces.where("conv_id = 50").count() > 1
    got = {x.conv_id: x for x in chat.chat_digests(pieces).collect()}
    turns += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert got.keys() == {c for c, *_ in turns}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, x in got.items():
        mine = [(role, t) for cc, _, role, t in turns if cc == c]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (x.n_turns, x.loss_chars, x.loss_sha256) == (len(mine), len(loss), sha(loss))
        assert x.turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in mine)) and x.formatted_chars == sum(len(formatted(*m)) for m in mine)
