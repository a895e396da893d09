import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudform.sources import arrays, shards


def test_rows_by_ranges_of_bytes(spark, tmp_path):
    m = {0: np.arange(700, dtype=np.float16).reshape(100, 7), 1: np.arange(12, dtype=">f8").reshape(3, 4), 2: np.zeros((0, 5), np.float32), 3: np.arange(4, dtype=np.float32)}
    for k, x in m.items():
        np.save(f"{tmp_path}/shard_000{k}_embeddings.npy", x)
    got = arrays.read_arrays(spark, str(tmp_path), size=200)
    assert got.rdd.getNumPartitions() == 8 + 1 + 1  # 14 rows of 14 bytes in a task, shard 2 in none
    rows = {(r.shard, r.row): r.embedding for r in got.collect()}
    assert rows == {(k, i): [float(v) for v in np.atleast_1d(r)] for k, x in m.items() for i, r in enumerate(x)}
    assert {(r.shard, r.n_rows, r.dim) for r in shards.shard_shapes(spark, str(tmp_path)).collect()} == {(0, 100, 7), (1, 3, 4), (2, 0, 5), (3, 4, 1)}


def test_headers_alone_are_read(tmp_path):
    p = f"{tmp_path}/a.npy"
    np.save(p, np.zeros((3, 2), np.float32))
    size = os.path.getsize(p)
    with open(p, "r+b") as f:
        f.truncate(size - 4)  # the body is cut
    assert arrays.header(f"file:{p}")[1:] == ((3, 2), size - 24)
    kind, _, start = arrays.header(p)
    assert len(list(arrays.rows_between(p, kind, 2, start, 0, 2))) == 1
    with pytest.raises(ValueError, match="ends before"):
        list(arrays.rows_between(p, kind, 2, start, 2, 3))
    with pytest.raises(ValueError, match="header has"):
        arrays.header(p, 64)
    np.save(p, np.asfortranarray(np.zeros((3, 2))))
    with pytest.raises(ValueError, match="columns"):
        arrays.header(p)


def test_no_arrays(spark, tmp_path):
    assert arrays.read_arrays(spark, str(tmp_path)).collect() == []


def test_embedding_job_and_resume(spark, tmp_path):
    def stand_in():  # a model that gives a text's length and its blanks; within the test, so that it travels by value
        def predict(texts):
            assert len(texts) <= 4
            return np.array([[len(t), t.count(" "), 1.0] for t in texts], np.float32)

        return predict

    folder = f"{tmp_path}/out"
    rows = [(i, f"t{i}", None if i % 5 == 0 else "a " * i) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, title string, abstract string").withColumn("text", arrays.joined_text(F.col("title"), F.col("abstract"), "[SEP]")).withColumn("shard", (F.col("id") % 3).cast("int"))
    done = arrays.embed_shards(df, folder, "id", "text", stand_in, batch=4, summary={"model": "stand-in"}).collect()
    assert sorted((r.shard, r.n_rows, r.dim) for r in done) == [(0, 7, 3), (1, 7, 3), (2, 6, 3)]
    files, shapes = shards.shard_files(spark, folder), shards.shard_shapes(spark, folder)
    index = shards.metadata_index(spark, folder, spark.createDataFrame([], "id long, title string, row int").schema)
    assert shards.shard_errors(files, shapes, index, expected=3, dim=3, dtype="float16", total=20).count() == 0
    got = {r.id: r.embedding for r in index.join(arrays.read_arrays(spark, folder), ["shard", "row"]).collect()}
    assert got == {i: [len(t) + 5 + len(a or ""), (a or "").count(" "), 1.0] for i, t, a in rows}
    os.remove(glob.glob(f"{folder}/shard_0001_embeddings.npy")[0])  # a run that broke
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/shard_000[02]*")}
    assert [r.shard for r in arrays.embed_shards(df, folder, "id", "text", stand_in, batch=4).collect()] == [1]
    assert before == {p: os.stat(p).st_mtime_ns for p in before} and len(glob.glob(f"{folder}/*")) == 9


def test_shards_refuse_vectors_that_differ(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, [1.0]), (0, 2, [1.0, 2.0])], "shard int, id long, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        arrays.write_shards(df, str(tmp_path), "id", "v").collect()
