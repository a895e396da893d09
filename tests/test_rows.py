"""Rows of metrics, acceptance, blocks of pairs, shapes, maps and joins against brute force."""

import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudform.functions import vec
from cloudform.operators import cloud, cluster, corpus, density, entities, models, profiles, projections, rows, shapes
from cloudform.sources import arrays, rest, shards, sinks
from cloudform.streaming import acceptance


def test_vector_functions(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, None, [1.0]), (3, [0.0, 0.0], [1.0, 1.0]), (4, [1.0, None], [1.0, 1.0]), (5, [1.0], [1.0, 2.0]), (6, [float("inf"), 1.0], [1.0, 1.0]), (7, [2.0], [2.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r for r in df.select("i", vec.unit("a").alias("u"), vec.norm("a").alias("n"), vec.cosine_distance("a", "b").alias("c"), vec.euclid("a", "b").alias("e"), vec.dot("a", "b").alias("d")).collect()}
    assert got[1].u == [0.6, 0.8] and got[1].n == 5 and got[1].c == pytest.approx(1 - 24 / 25) and got[1].e == pytest.approx(2**0.5) and got[1].d == 24
    assert [got[i].u for i in (2, 3, 4, 6)] == [None] * 4 and got[7].u == [1.0]
    assert got[3].c is None and got[5].e is None and got[2].d is None
    assert df.where("i in (1, 7)").groupBy("i").agg(F.avg(vec.euclid("a", "b")).alias("e")).count() == 2
    mean = vec.centroids(df.where("i in (1, 3)").select(F.lit(0).alias("g"), "a"), ["g"], "a").first()
    assert mean.centroid == [1.5, 2.0]


def test_year_windows():
    assert rows.year_window(2003, 2006) == {"year_min": 2003, "year_max": 2006, "early_min": 2003, "early_max": 2006, "late_min": 2003, "late_max": 2006}
    assert rows.year_window(2000, 2024)["late_min"] == 2020
    for bad in ((2010, 2005), (1999, 2005), (2010, 2025)):
        with pytest.raises(ValueError):
            rows.year_window(*bad)


def test_drift_of_a_short_range(spark):
    v = [(i, 0, 2000 + i // 3, x) for i, x in enumerate([[1.0, 0.0]] * 6 + [[0.0, 1.0]] * 12)]
    r = cloud.unit_rows(spark.createDataFrame(v, "id int, g int, year int, embedding array<double>"))
    got = cloud.drift(r, "g", 2000, 2005).first()
    early, late = np.array([6.0, 9.0]), np.array([3.0, 12.0])  # years 2000-2004 and 2001-2005
    assert got.drift == pytest.approx(1 - early @ late / np.linalg.norm(early) / np.linalg.norm(late)) and (got.n_early, got.n_late) == (15, 15)


def test_group_rows_keep_what_fails(spark):
    rng = np.random.default_rng(0)
    good = [(i, "good", 2000 + i % 25, rng.normal(size=4).tolist()) for i in range(200)]
    odd = [(1000 + i, "zero", 2000, [0.0] * 4) for i in range(8)] + [(2000, "few", 2000, [1.0] * 4)] + [(3000 + i, "one", 2001, [1.0, 0.0, 0.0, 0.0] if i == 0 else None) for i in range(5)]
    got = {r.g: r for r in rows.group_metrics(spark.createDataFrame(good + odd, "id long, g string, year int, embedding array<double>"), "g", "id", 3, 2000, 2024, least=2).collect()}
    assert {g: r.status for g, r in got.items()} == {"good": "completed", "zero": "failed", "few": "skipped", "one": "completed_with_warnings"}
    assert got["zero"].error and got["zero"].n_used == 0 and got["zero"].mean_distance is None and got["few"].error and got["few"].n_available == 1
    assert "direction" in got["one"].warnings and got["one"].n_used == 1 and got["one"].effective_k == 0 and got["good"].warnings == ""
    u = np.array([x[3] for x in good])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    assert got["good"].median_knn == pytest.approx(np.median(np.sort(d, 1)[:, :3])) and got["good"].n_axes == 4
    man = {r.g: r.status for r in sinks.manifest(spark.createDataFrame([("a", 1, 1, "odd")], "g string, n_available int, n_used int, s string"), "g", F.col("s"), run={"k": "3"}).collect()}
    assert man == {"a": "failed"}


def test_window_rows(spark):
    rng = np.random.default_rng(1)
    v = cloud.unit_rows(spark.createDataFrame([(i, i % 2, 2000 + i % 10 if i < 90 else 2001, rng.normal(size=5).tolist()) for i in range(120)], "id long, g int, year int, embedding array<double>"))
    from cloudform.operators import temporal

    out = {(r.g, r.window_index): r for r in rows.window_group_metrics(v, temporal.windows(spark, 2000, 2014), "g", "id", 4, 3, 2000, 2014).collect()}
    assert len(out) == 6 and out[0, 2].status == "skipped" and out[0, 2].d80 is None and out[1, 0].entropy > 0.5 and out[1, 1].median_knn > 0


def sequential(items, plan, per_entity):
    seen, cells, ents, out = set(), {}, {}, []
    for i, c, e in items:
        if i in seen:
            out.append("repeated")
        elif cells.get(c, 0) >= plan.get(c, 0):
            out.append("cell_full")
        elif ents.get(e, 0) >= per_entity:
            out.append("entity_full")
        else:
            out.append("accepted")
            seen.add(i)
            cells[c], ents[e] = cells.get(c, 0) + 1, ents.get(e, 0) + 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptance_in_order(spark, seed):
    r = random.Random(seed)
    items = [(r.randrange(60), (e := r.randrange(6)), r.randrange(3)) for _ in range(400)]
    plan = {(e, y): r.randrange(0, 9) for e in range(6) for y in range(3)}
    df = spark.createDataFrame([(t, i, e, y) for t, (i, e, y) in enumerate(items)], "t int, id int, e int, y int")
    p = spark.createDataFrame([(e, y, n) for (e, y), n in plan.items()], "e int, y int, planned int")
    got = [x.decision for x in corpus.accept(df, "id", ["e", "y"], "e", ["t"], p, 14).orderBy("t").collect()]
    want = sequential([(i, (e, y), e) for i, e, y in items], plan, 14)
    assert [g == "accepted" for g in got] == [w == "accepted" for w in want] and got == want


@pytest.mark.parametrize("tail", [7, 40])
def test_acceptance_in_rounds_of_bounded_tasks(spark, tail):
    r = random.Random(tail)
    items = [(r.choice([None, *range(80)]), (e := r.randrange(5)), r.randrange(3)) for _ in range(500)]
    plan = {(e, y): r.randrange(0, 14) for e in range(5) for y in range(3)}
    df = spark.createDataFrame([(t, i, e, y) for t, (i, e, y) in enumerate(items)], "t int, id int, e int, y int")
    p = spark.createDataFrame([(e, y, n) for (e, y), n in plan.items()], "e int, y int, planned int")
    got = [x.decision for x in corpus.accept(df, "id", ["e", "y"], "e", ["t"], p, 20, tail=tail).orderBy("t").collect()]
    assert got == sequential([(i, (e, y), e) for i, e, y in items], plan, 20)


def test_acceptance_of_ids_of_one_cell(spark):
    r = random.Random(9)
    items = [(e * 1000 + y * 100 + r.randrange(12), e, y) for e, y in ((r.randrange(4), r.randrange(3)) for _ in range(300))]
    df = spark.createDataFrame([(t, i, e, y) for t, (i, e, y) in enumerate(items)], "t int, id int, e int, y int")
    got = [x.decision for x in corpus.accept(df, "id", ["e", "y"], "e", ["t"], 5, 11).orderBy("t").collect()]
    assert got == sequential([(i, (e, y), e) for i, e, y in items], {(e, y): 5 for e in range(4) for y in range(3)}, 11)


def test_an_id_refused_by_a_full_cell_enters_another(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "a"), (3, "y", "b")], "t int, id string, cell string")
    assert [x.decision for x in corpus.accept(df, "id", ["cell"], "cell", ["t"], 1, 9).orderBy("t").collect()] == ["accepted", "cell_full", "accepted"]


def test_backfill_goes_on_until_cells_are_full(spark):
    plan = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "cell string, planned int")
    asked = []

    def fetch(req, i):
        some = req.collect()
        asked.append({r.cell: r.n for r in some})
        return spark.createDataFrame([(i * 100 + k, r.cell) for r in some if r.cell != "c" for k in range(2)], "id int, cell string")

    kept, sizes = corpus.backfilled(plan, ["cell"], fetch, lambda r: corpus.balanced(r, "cell", "id", 5, 0), lambda short, i: short.select("cell", F.col("shortfall").alias("n")), 6)
    assert sizes == [4, 8, 9, 9] and {r.cell: r.n for r in kept.groupBy("cell").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 4} and asked[0] == {"a": 5, "b": 3, "c": 2}


def test_silhouettes_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 3)) + c for c in (0, 3, [0, 5, 0])] + [np.full((1, 3), 9.0)])
    y = np.repeat([0, 1, 2, 3], [30, 30, 30, 1])
    monkeypatch.setattr(cluster, "BLOCK", 20)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, c int, x array<double>")
    got = {r.id: r.silhouette for r in cluster.silhouettes(df, "id", "c", "x").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        means = [d[i, (y == c) & (np.arange(len(x)) != i)].mean() if ((y == c) & (np.arange(len(x)) != i)).any() else None for c in range(4)]
        own, other = means[y[i]], min(m for c, m in enumerate(means) if c != y[i])
        assert got[i] == pytest.approx(0 if own is None else (other - own) / max(own, other))


def test_neighbours_piece_by_piece(monkeypatch):
    monkeypatch.setattr(cloud, "PIECE", 7, raising=False)
    u = np.random.default_rng(5).integers(-1, 2, (60, 3)).astype(float) + 0.25  # many ties
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = np.random.default_rng(6).permutation(60)
    d = np.round(np.clip(1 - u @ u.T, 0, 2), 12)
    for k in (1, 4, 70):
        for q, c in ((slice(0, 60), slice(0, 60)), (slice(0, 25), slice(25, 60))):
            got = [(ids[q][i], ids[c][j]) for r, t, _ in cloud._best(u[q], u[c], ids[q], ids[c], k, q == c) for i, j in zip(r, t, strict=True)]
            want = [(i, ids[c][j]) for n, i in enumerate(ids[q]) for j in [j for j in np.lexsort((ids[c], d[q, c][n])) if ids[c][j] != i][:k]]
            assert got == want


def test_neighbours_send_few_copies(spark, monkeypatch):
    """A vector travels once for each chunk of its group, and each chunk answers with k rows for it."""
    monkeypatch.setattr(cloud, "_nearest", lambda k: lambda t: pa.table({"g": t.column("g")[:1], "src": [t.column("row")[0].as_py() * 100 + t.column("col")[0].as_py()], "dst": [len(t)], "d": [0.0]}))
    r = spark.range(5000).select("id", F.lit(0).alias("g"), F.array(F.lit(1.0), F.lit(0.0)).alias("u"))
    assert sum(x.dst for x in cloud.neighbours(r, "g", "id", 4).collect()) == 5000


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(cloud, "CAP", 16)
    x = np.random.default_rng(4).normal(size=(70, 5))
    x[10] = x[20]
    r = cloud.unit_rows(spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, g int, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.clip(1 - u @ u.T, 0, 2), 12)
    np.fill_diagonal(d, 9)
    want = {(i, int(j), k + 1) for i in range(70) for k, j in enumerate(np.lexsort((np.arange(70), d[i]))[:4])}
    assert {(a.src, a.dst, a.rank) for a in cloud.neighbours(r, "g", "id", 4).collect()} == want


def prim(p):
    n, out, todo, far, at = len(p), [], np.ones(len(p), bool), np.full(len(p), np.inf), 0
    for _ in range(n - 1):
        todo[at] = False
        far = np.minimum(far, np.hypot(*(p - p[at]).T))
        at = int(np.where(todo, far, np.inf).argmin())
        out.append(far[at])
    return np.array(out)


def test_spanning_trees():
    rng = np.random.default_rng(5)
    for p in (rng.normal(size=(3000, 2)), np.concatenate([rng.normal(size=(300, 2)) * 0.01 + c for c in rng.normal(size=(9, 2)) * 50]), rng.integers(0, 9, (400, 2)).astype(float), np.zeros((50, 2)), np.stack([np.zeros(90), rng.normal(size=90)], 1), rng.normal(size=(1, 2)), np.zeros((0, 2))):
        assert np.allclose(np.sort(shapes.spanning_edges(p)), np.sort(prim(p)))


def test_neighbours_in_the_plane_need_no_whole_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(60, 2)) * 1e-3 + 2, rng.integers(0, 3, (90, 2)), rng.normal(size=(9, 2)) * 90, np.ones((40, 2))]).astype(float)
    groups = {0: p, 1: p[:1], 2: p[:4], 3: np.zeros((50, 2)), 4: p[300:420]}
    real = shapes._nearest

    def bounded(*how):
        run = real(*how)

        def checked(t):
            if t.column("own").to_numpy(zero_copy_only=False).sum() > 16:
                raise ValueError("a whole group")
            return run(t)

        return checked

    monkeypatch.setattr(shapes, "_nearest", bounded)
    rows = [(g, *map(float, v)) for g, q in groups.items() for v in q]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (2, float("nan"), 1.0)], "g int, x double, y double")
    got = {(r.g, r.x, r.y): r.d for r in shapes.kth_distances(df, "g", "x", "y", 5, size=16).collect()}
    want = {}
    for g, q in groups.items():
        d = np.sort(np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)), axis=1)[:, 1:]
        want |= {(g, *map(float, v)): d[i, min(5, d.shape[1]) - 1] for i, v in enumerate(q) if d.shape[1]}
    assert got == want


def test_maps_keep_neighbours():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 10)) * 0.1 + rng.normal(size=10) * 4 for _ in range(4)])
    names = np.repeat(np.arange(4), 40)
    for m in projections.METHODS:
        y = projections.mapped(x, m)
        d = models.gaps(y)
        np.fill_diagonal(d, np.inf)
        assert (names[d.argmin(1)] == names).mean() > 0.95 and projections.trustworthiness(models.gaps(x), y) > 0.7
    assert projections.trustworthiness(models.gaps(x[:, :2]), x[:, :2]) == 1.0 and projections.trustworthiness(np.zeros((2, 2)), np.zeros((2, 2))) is None
    with pytest.raises(ValueError):
        projections.mapped(x, "umap")


def test_nearest_affinity_and_grids(spark):
    x = np.concatenate([np.random.default_rng(7).normal(size=(12, 2)) * 0.1 + c for c in (0, 5)])
    y = models.labelled(x, 2, "spectral:knn5")
    assert len({*y[:12]}) == 1 and len({*y[12:]}) == 1 and y[0] != y[12]
    pairs = spark.createDataFrame([(i, j, float(np.hypot(*(x[i] - x[j])))) for i in range(24) for j in range(i + 1, 24)], "a int, b int, d double")
    got = models.distance_grid(pairs, "d", ["average"], [2]).first()
    assert (got.min_size, got.max_size) == (12, 12) and got.silhouette > 0.9


def test_kernel_density_sums_to_one(spark):
    p = spark.createDataFrame([(g, float(a), float(b)) for g in (0, 1) for a, b in np.random.default_rng(8).normal(size=(60, 2)) * 0.2], "g int, x double, y double")
    for most in (5000, 10):
        got = {r.g: r.s for r in density.kernel_cells(p, ["g"], "x", "y", -1.0, 1.0, 6, most=most).groupBy("g").agg(F.sum("mass").alias("s")).collect()}
        assert got == {0: pytest.approx(1.0), 1: pytest.approx(1.0)}


def test_kernel_density_of_many_points(spark):
    x = np.random.default_rng(8).normal(size=(5200, 2)) * 0.2
    p = spark.createDataFrame([(0, float(a), float(b)) for a, b in x], "g int, x double, y double")
    got = {(r.ix, r.iy): r.mass for r in density.kernel_cells(p, ["g"], "x", "y", -1.0, 1.0, 6).collect()}
    inv, at = np.linalg.inv(np.cov(x.T)) * len(x) ** (1 / 3), -1 + (np.arange(6) + 0.5) / 3
    want = np.array([[np.exp(-0.5 * np.einsum("ni,ij,nj->n", [a, b] - x, inv, [a, b] - x)).sum() for b in at] for a in at])
    assert len(got) == 36 and all(got[i, j] == pytest.approx(want[i, j] / want.sum()) for i in range(6) for j in range(6))


def test_similarity_rules(spark):
    long = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 1.0), ("b", "m", 1.0), ("b", "n", 1.0), ("c", "m", 2.0), ("c", "n", 3.0), ("d", "m", 0.0)], "entity string, metric string, scaled double").withColumn("w", F.lit(0))
    got = {(r.a, r.b): (round(r.euclid, 6), r.corr) for r in profiles.similarities(long, ("w",)).collect()}
    assert got["a", "b"] == (0.0, 0.0) and got["a", "c"][1] is None and got["a", "d"] == (1.0, None)


def test_flags_and_joins(spark):
    df = spark.createDataFrame([(1, "true", "x"), (2, None, "")], "id int, main_v2 string, name string")
    gens = [{"main": "main_v3", "strict": "strict_v3"}, {"main": "main_v2"}]
    got = entities.resolved_flags(df, gens, ("main",), {"eligible": "main"}).collect()
    assert [(r.main, r.strict, r.eligible) for r in got] == [(True, None, True), (None, None, None)]
    with pytest.raises(ValueError, match="main_v3"):
        entities.resolved_flags(df, gens[:1], ("main",), {})
    right = spark.createDataFrame([(1, "r")], "id int, v string")
    assert entities.many_to_one(df, right, "id").count() == 2
    with pytest.raises(ValueError, match="without"):
        entities.many_to_one(df, right, "id", all_match=True)
    with pytest.raises(ValueError, match="repeats"):
        entities.many_to_one(df, right.union(right), "id")
    with pytest.raises(ValueError, match="missing values"):
        entities.strict_metrics(df, "id", ["name"])
    assert [r.row_id for r in entities.numbered(spark.range(50).withColumn("g", F.col("id") % 3), ["g"], "id").orderBy("g", "id").collect()] == list(range(50))
    assert entities.level_columns("a", {"a": ("i", "n")}) == ("i", "n") and entities.with_absent(df, {"name": F.lit(0), "year": F.lit(1)}).first().year == 1
    with pytest.raises(ValueError):
        entities.chosen(df, "id", only=[9])
    assert entities.chosen(df, "id", first=1).first().id == 1 and df.select(entities.size_list(F.lit("11; 40;"))).first()[0] == [11, 40]


def test_shards(spark, tmp_path):
    for k, n in ((0, 3), (1, 2)):
        np.save(f"{tmp_path}/shard_000{k}_embeddings.npy", np.arange(n * 4, dtype=np.float16).reshape(n, 4))
        spark.createDataFrame([(k * 10 + i, i) for i in range(n)], "id int, row int").coalesce(1).write.parquet(f"{tmp_path}/m{k}")
    import glob
    import shutil

    for k in (0, 1):
        shutil.copy(glob.glob(f"{tmp_path}/m{k}/part*.parquet")[0], f"{tmp_path}/shard_000{k}_metadata.parquet")
        shutil.rmtree(f"{tmp_path}/m{k}")
    files, shapes_ = shards.shard_files(spark, str(tmp_path)), shards.shard_shapes(spark, str(tmp_path))
    assert {(r.shard, r.dtype, r.n_rows, r.dim) for r in shapes_.collect()} == {(0, "float16", 3, 4), (1, "float16", 2, 4)}
    meta = shards.metadata_index(spark, str(tmp_path), spark.createDataFrame([], "id int, row int").schema)
    assert {(r.shard, r.id, r.row) for r in meta.collect()} == {(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 10, 0), (1, 11, 1)}
    assert shards.shard_errors(files, shapes_, meta, expected=2, dim=4, dtype="float16", total=5).count() == 0
    bad = {(r.shard, r.error) for r in shards.shard_errors(files.where("kind <> 'metadata' or shard = 0"), shapes_, meta.where("id <> 11"), expected=3, dim=5, dtype="float16", total=6).collect()}
    assert (1, "no metadata") in bad and (1, "2 vectors, 1 rows of metadata") in bad and (None, "2 shards, not 3") in bad and (None, "5 vectors in all, not 6") in bad and (0, "dimension 4, not 5") in bad
    vectors = arrays.read_arrays(spark, str(tmp_path), size=16)
    assert [r.embedding[0] for r in shards.aligned(meta, vectors, ["shard", "row"]).orderBy("id").collect()] == [0.0, 4.0, 8.0, 0.0, 4.0]
    with pytest.raises(ValueError):
        shards.aligned(meta.withColumn("row", F.col("row") + 5), vectors, ["id"])
    assert shards.out_of_bounds(meta.withColumn("row", F.col("row") + 1), shapes_).count() == 2
    assert [r.shard for r in shards.shards_to_do(spark.range(3).select(F.col("id").cast("int").alias("shard")), files).collect()] == [2]


def test_sinks(spark, tmp_path):
    sinks.write_json(spark, f"{tmp_path}/a.json", {"x": float("nan"), 1: [np.int64(3), {"y": float("inf")}]})
    assert json.loads((tmp_path / "a.json").read_text()) == {"x": None, "1": [3, {"y": None}]}
    sinks.write_markdown(spark.createDataFrame([(1, 0.5, "a|b")], "i int, x double, t string"), f"{tmp_path}/a.md", "Title")
    assert (tmp_path / "a.md").read_text() == "# Title\n\n| i | x | t |\n| - | - | - |\n| 1 | 0.5 | a\\|b |\n"
    t = sinks.replace_table(spark.range(3), "cloudform_test", f"{tmp_path}/t")
    assert t.count() == 3 and sinks.replace_table(spark.range(2), "cloudform_test", f"{tmp_path}/t").count() == 2
    spark.sql("DROP TABLE cloudform_test")
    with pytest.raises(ValueError):
        sinks.replace_table(spark.range(1), "a; drop")


def test_composed_requests():
    assert rest.composed({"type": ["article", "review"], "language": "en", "is_retracted": False, "none": None}, select=["id", "title"], sample=5, seed=3, year=2001) == {"filter": "type:article|review,language:en,is_retracted:false,publication_year:2001", "select": "id,title", "sample": 5, "seed": 3}
    assert rest.composed(years=(2000, 2004), group_by="year") == {"filter": "publication_year:2000-2004", "group_by": "year"}
    with pytest.raises(ValueError):
        rest.composed(sample=1, group_by="x")
    waits = []

    def busy(url, timeout):
        raise TimeoutError

    with pytest.raises(RuntimeError, match="pauses"):
        rest.fetch("http://x?api_key=1", sleep=waits.append, get=busy, most_total=5)
    assert waits == [1.0, 2.0]
    pages = {1: [{"i": 0}, {"i": 1}], 2: [{"i": 2}]}
    get = lambda url, timeout: json.dumps({"results": pages[int(url.rsplit("page=", 1)[1])]})
    assert [r["i"] for r in rest.sampled("http://x", {}, 9, size=2, get=get)] == [0, 1, 2]


def test_stream_keeps_its_caps(spark, tmp_path):
    from datetime import datetime

    rows_ = [(i % 7, 1, "a" if i % 2 else "b", datetime(2024, 1, 1 + i % 5)) for i in range(40)]
    for k in range(3):  # the same events come again in later files
        spark.createDataFrame(rows_[: 14 + k * 13], "event_id long, user_id long, event_type string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = acceptance.finished(acceptance.accepted(stream, 3)).collect()
    assert len(got) == 6 and len({(r.user_id, r.event_type, r.event_id) for r in got}) == 6


def test_distances_of_many_vectors_in_little_memory():
    x = np.random.default_rng(1).normal(size=(900, 64))
    tracemalloc.start()
    d = models.gaps(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * d.nbytes and np.array_equal(d[:3], np.sqrt(((x[:3, None] - x[None]) ** 2).sum(-1)))


def test_words_of_an_index_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, None), (3, "")], "id int, text string")
    index = corpus.inverted_index(df, "id", "text")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.t for r in index.select("id", corpus.rebuilt("index").alias("t")).collect()} == {1: "b a b c", 2: None, 3: ""}


def test_silhouettes_copy_points_few_times(spark):
    df = spark.range(33000).select("id", F.lit(0).cast("long").alias("c"), F.array(F.col("id").cast("double")).alias("x"))
    assert cluster.dealt(df).count() == 3 * 33000
    wide = spark.range(3).select("id", F.lit(0).cast("long").alias("c"), F.array_repeat(F.lit(1.0), 1 << 19).alias("x"))
    assert cluster.dealt(wide).count() == 2 * 3


def test_cells_of_a_stream_share_buckets(spark, tmp_path):
    rows = [(i, c % 40, f"t{c % 3}", i // 7) for i, c in enumerate(random.Random(2).choices(range(120), k=600))] + [(900 + i, None, None, i) for i in range(5)]
    kind = "event_id long, user_id long, event_type string, ts long"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/e")
    got = acceptance.finished(acceptance.accepted(stream, 3, buckets=2)).collect()
    want: dict = {}
    for i, u, t, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want.setdefault((u, t), []).append(i)
    have: dict = {}
    for r in got:
        have.setdefault((r.user_id, r.event_type), []).append(r.event_id)
    assert {k: sorted(v) for k, v in have.items()} == {k: v[:3] for k, v in want.items()}
