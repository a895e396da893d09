import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloudform.llm import bpe, chat, embedding_dedup, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, source string, counts string, n long"
WORDS = [a + b for a in "bcdfgl" for b in ("a", "e", "ou", "é")]


def texts(seed=0):
    r = random.Random(seed)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    base = make(120)
    near = base.split()
    near[3], near[60] = "changed", "words"
    out = [base, base, " ".join(near), make(90), make(90) + " " + base[:260], None, "", "   \n", "one two", "One TWO", "a" * 3000, make(5000), base]
    return [(i, t, None if i % 5 == 4 else f"s{i % 3}", "x", i) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts() + [texts()[3]], DOCS)  # the last row repeats one


def test_ngram_join(spark, docs):
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(docs).collect()}
    sets = {}
    for i, t, *_ in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), comp[i]) for i in sets}
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0


def test_ngram_join_of_long_texts(spark):
    run = lambda name, n: [f"{name}{k}" for k in range(n)]
    core, common = run("c", 40000), run("b", 6000)
    rows = [(0, core + run("a", 6000))] + [(i, core + common + run(f"v{i}x", 3000)) for i in range(1, 36)]  # over 32 that link with each other, not with 0
    sets = [{hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)} for _, w in rows]
    comp = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    assert comp == [0] + [1] * 35
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert [got[i] for i in range(len(rows))] == comp


def test_suffix_dedup(spark, docs):
    rows = texts() + [texts()[3]]
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {}
    for k, (_, t) in enumerate(raw):
        for a in range(len(t) - 199):
            seen.setdefault(t[a : a + 200], []).append((k, a))
    gone = [np.zeros(len(t), bool) for _, t in raw]
    for spots in seen.values():
        if len(spots) > 1:
            for k, a in spots:
                gone[k][a : a + 200] = True
    want = sorted((i, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()) for (i, t), g in zip(raw, gone, strict=True))
    got = suffix_dedup.suffix_dedup(docs)
    assert sorted((r.doc_id, r.s) for r in got.select("doc_id", F.sha2("kept", 256).alias("s")).collect()) == want
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_array():
    for t in (b"abracadabra" * 9, b"aaaaaaaa", b"mississippi"):
        order, place = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        got = suffix_dedup.common_prefixes(np.frombuffer(t, np.uint8), order, place, 200)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            assert got[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100, "it's  <|endoftext|> 12é\u0085\n\n x", "s", "x", 0), (101, "aaaa" * 50, "s", "x", 0)], DOCS)
    for r, t in zip(bpe.bpe_decode(bpe.bpe_encode(docs.union(extra).coalesce(1), path=path), path=path).collect(), [*[x[1] for x in texts()], texts()[3][1], "it's  <|endoftext|> 12é\u0085\n\n x", "aaaa" * 50], strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids and r.text == (t or "")


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[10:20] = x[0] + rng.normal(size=(10, 8)).astype(np.float32) * 0.05
    x[20] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [None] * 8), (104, [1.0])]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(60)
    for _ in range(60):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(60)])
    assert [(got[i].n_links, got[i].component_id) for i in range(60)] == [(int(link[i].sum()), int(comp[i])) for i in range(60)]
    assert all(got[i].n_links == 0 and got[i].kept for i in range(100, 105))


def test_chat(spark):
    turns = [(1, 0, "user", "a ### b \\ </turn> ####"), (1, 1, "assistant", "x\\### Assistant: </turn>\n"), (None, 0, "assistant", None), (2, 0, None, "é"), (2, 0, "we:ird\n", "")]
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n" + turns[0][3] + "\nassistant\n" + turns[1][3] + "\n") and got[1].loss_sha256 == sha(turns[1][3])
    assert got[2].turns_sha256 == sha("\né\nwe:ird\n\n\n") and got[2].n_turns == 2 and got[None].loss_chars == 0


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 14 and all(0 <= r.copies <= 3 for r in rows)
    assert mixing.shares([10, 10], [1, 9], 1.5) == [5.0, 15.0]
    assert {r.size for r in rows if r.doc_id in (5, 6, 7)} == {0}
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_url_filter(spark):
    pages = [(1, "http://a.ORG/x"), (2, "https://b.example.org/es/1?q"), (3, "x.com/fr/"), (4, None), (5, "http://com/de/#f"), (6, "http://spam.net/a/")]
    listed = spark.createDataFrame([("spam.net/a",), (None,), ("spam.net/a",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), listed).collect()}
    assert got == {1: ("a.org", "/x", "org/", "allow"), 2: ("b.example.org", "/es/1", "example.org/es/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("com", "/de/", "com/de/", "block"), 6: ("spam.net", "/a/", None, "block")}


def test_license_scan(spark):
    rows = [(1, "MIT License\nreleased under the mit\nRELEASED, under a MIT licence"), (2, None), (3, "cc-by cc by")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels) == (11, 1, 0, "mit")
    assert (got[2].n_words, got[2].labels, got[2].score) == (0, "", 0.0) and (got[3].n_base, got[3].last_word) == (2, 2)


def test_quality(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality_rules.learn_rules(x, y)
    hit = np.any([quality_rules.covers(r, x) for r in rules], axis=0)
    assert (hit == y).mean() > 0.95
    rows = quality_rules.quality_rules(quality_rules.text_statistics(docs), []).collect()
    assert len(rows) == 14 and {r.doc_id for r in rows if r.n_words == 0} == {5, 6, 7}


def test_toxicity(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(60)) + (" vilest scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    tables = toxicity.fit_toxicity(docs, docs.where("doc_id < 300").select("doc_id", "toxic"))
    got = toxicity.score_toxicity(docs, tables).where("doc_id >= 300").collect()
    assert np.mean([(x.score >= 0.5) == bool(x.toxic) for x in got]) > 0.95
    assert toxicity.fit_toxicity(docs, docs.where("toxic = 0").select("doc_id", "toxic")) is None


def test_toxicity_keeps_class_shares(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(20)), int(r.random() < 0.1)) for i in range(3000)]  # words tell nothing, so scores are near the share
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    for most in (8192, 250):
        tables = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"), most=most)
        assert 0.05 < toxicity.score_toxicity(docs, tables).agg(F.avg("score")).first()[0] < 0.2
