"""Results stay the same where chunks, shards and ranges are small, and no group grows with the table."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cloudform.llm import chat, embedding_dedup, suffix_dedup, toxicity


def test_cells_are_dealt_in_chunks_of_own_vectors_and_guests(spark, monkeypatch):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 8))
    x[::3] = x[0] + r.normal(0, 0.15, (500, 8))  # a hot spot
    x = np.concatenate([x, x[:20]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        low = np.minimum(comp, np.where(near, comp[None], len(x)).min(1))
        if (low == comp).all():
            break
        comp = low
    cap, real = 40, embedding_dedup.linked

    def bounded(cosine):
        run = real(cosine)

        def checked(group):
            if group.num_rows > 4 * cap:
                raise ValueError(f"a block of {group.num_rows} vectors")
            return run(group)

        return checked

    monkeypatch.setattr(embedding_dedup, "CAP", cap)
    monkeypatch.setattr(embedding_dedup, "linked", bounded)
    df = spark.createDataFrame([(2 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {row.vec_id: (row.n_links, row.component_id) for row in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {2 * i: (int(near[i].sum()), 2 * int(comp[i])) for i in range(len(x))} and near.sum() > 10_000


def test_turns_that_start_alike(spark):
    texts = [("x" * 70) + str(k % 7) + "y" * k for k in range(60)]
    rows = [(1, 0, "user", t) for t in texts] + [(2, k, "assistant", "same") for k in range(5)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chat(df)).collect()}
    want = "".join(f"user\n{t}\n" for t in sorted(texts))
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[2].n_turns == 15


def test_shards_close_by_the_bytes_of_their_texts(spark, monkeypatch):
    r = np.random.default_rng(1)
    part = bytes(r.integers(97, 123, 700, np.uint8)).decode()
    rows = [(i, bytes(r.integers(97, 123, 500, np.uint8)).decode() + part[i % 300 : i % 300 + 350] + bytes(r.integers(97, 123, 300, np.uint8)).decode()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(map(tuple, suffix_dedup.suffix_dedup(df).select("doc_id", F.sha2("kept", 256)).collect()))
    want = kept()
    monkeypatch.setattr(suffix_dedup, "HELD", 3000)
    assert kept() == want and want != sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("stage", ["drop_near_copies", "mix"])
def test_repeated_ids_beside_columns_without_an_order(spark, tmp_path, stage):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "s", {"a": k}) for k in (3, 1, 2)] + [(2, "another text of a few words", "s", None), (1, text, "s", {"a": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>").withColumn("v", F.expr("parse_json('{\"b\": 1}')"))
    out = getattr(P, stage)(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(set(ids)) == [1, 2] and (stage == "mix" or len(ids) == 2)


def shuffled(spark):
    """Bytes that tasks of this session have written for shuffles, of a local master."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_toxic_stage_shuffles_verdicts_not_texts(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    tail = lambda: "".join(chr(r.randrange(33, 48)) for _ in range(20000))  # no words, and hard to pack
    rows = [(i, " ".join(r.choice(["good", "kind", "plain", "odd", "vile", "scum"][: 6 if i % 3 == 0 else 4]) for _ in range(12)) + tail(), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([*rows, rows[1], (None, "kind good", 0), (500, None, 0)], "doc_id long, text string, toxic int")
    docs.where("doc_id < 150").select("doc_id", "toxic").distinct().write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    fit = toxicity.fit_toxicity
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda d, labels: fit(d, labels, rows=2))  # words are left to the table
    before = shuffled(spark)
    got = P.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert shuffled(spark) - before < 1e6  # the texts are 3 MB
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet").where(toxicity.fold("doc_id") != 0))
    want = toxicity.score_toxicity(docs, model, own=True).where("score < 0.5").drop("score").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and 50 < len(got) < 140


def test_counts_of_words_travel_without_hashes():
    batch = pa.RecordBatch.from_pydict({"text": ["a bb a", "Bb"], "part": [0, 1]})
    (got,) = toxicity.counted("part")(iter([batch]))
    assert sorted(zip(*got.to_pydict().values(), strict=True)) == [(b"a", 2, 0, 0), (b"bb", 1, 1, 0)]


def test_tiles_take_bounded_memory():
    """What a task of the suffix arrays' first pass holds beside its batch, for texts of 2 MB."""
    rng = np.random.default_rng(5)
    batch = pa.RecordBatch.from_pydict({"k1": np.arange(500), "k2": np.arange(500), "text": [bytes(rng.integers(97, 123, 4096, np.uint8)).decode() for _ in range(500)]})
    run = suffix_dedup.tile_blocks(200, 128)
    sum(len(x) for x in run([batch.slice(0, 5)]))
    tracemalloc.start()
    entries = sum(len(v.as_py()) // 8 for x in run([batch]) for v in x.column(x.schema.get_field_index("piece")))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert entries > 20000 and most < 20 << 20
