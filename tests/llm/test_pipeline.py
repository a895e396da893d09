"""The pipeline's stages against brute force, on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone_word string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def kept_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def fixture(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(rng.randrange(3, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 5].upper() + (" tail" if i % 2 else "")) for i in range(12)]
    rows += [(200, None), (201, ""), (202, "  \n "), (203, "word"), (204, "word")]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in rows], SCHEMA)
    return rows, df


def test_near_copies(spark):
    rows, df = fixture(spark)
    nobody = spark.createDataFrame([(None, "no id", "en", "s", 5, "x"), (None, "no id", "en", "s", 5, "x")], SCHEMA)
    out = P.drop_near_copies(spark, df.union(nobody), "")
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(kept_by_hand(rows)) and got.count(None) == 2


def test_bitmap_that_is_full_stays_exact(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    gone = df.where("doc_id % 3 = 0").select("doc_id")
    assert sorted(r.doc_id for r in P.without(df, gone, bits=32).collect()) == [i for i in range(200) if i % 3]
    assert P.without(df, gone.limit(0)).count() == 200


def test_repeats_go_and_the_rest_stays(spark):
    long = "".join(random.Random(5).choices("abcdefghij ", k=260))
    df = spark.createDataFrame([(1, "x" + long + "é", "en", "s", 0, "x"), (2, "y" + long, "en", "s", 0, "x"), (3, "alone", "en", "s", 0, "x"), (4, None, "en", "s", 0, "x")], SCHEMA)
    got = {r.doc_id: (r.text or "", r.n_chars) for r in P.drop_repeats(spark, df, "").collect()}
    assert got == {1: ("xé", 2), 2: ("y", 1), 3: ("alone", 5), 4: ("", 0)}


def test_mix_and_tokens(spark):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    _, df = fixture(spark)
    mixed = P.mix(spark, df, "")
    assert mixed.columns == df.columns and max(r["count"] for r in mixed.where("doc_id is not null").groupBy("doc_id").count().collect()) <= 3
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    for r in P.tokenize(spark, df, "").join(df.select("doc_id", "text"), "doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
