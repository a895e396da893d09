import numpy as np
import pytest

from cloudform.operators import trees

M = 6


def reach(x, k):
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None], 0))
    d = np.maximum(d, d.T)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1] if k else np.zeros(len(x))
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def kruskal(w):
    top, out = list(range(len(w))), []

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for v, a, b in sorted((w[a, b], a, b) for a in range(len(w)) for b in range(a + 1, len(w))):
        if find(a) != find(b):
            top[find(a)] = find(b)
            out.append((v, a, b))
    return out


def parts(points, edges):
    near = {p: [] for p in points}
    for _, a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, out = set(), []
    for p in points:
        if p not in seen:
            todo, own = [p], set()
            while todo:
                q = todo.pop()
                if q not in own:
                    own.add(q)
                    todo += near[q]
            seen |= own
            out.append(own)
    return out


def best(points, edges, birth, root=False):
    """From the top down: (worth, clusters) of a cluster; its longest edges are cut one by one."""
    left, total, now = set(points), 0.0, sorted(edges)
    while True:
        if not now:
            raise AssertionError
        v, a, b = now.pop()
        dense = 1 / max(v, trees.LEAST)
        pieces = parts(left, now)
        one = next(p for p in pieces if a in p)
        two = next(p for p in pieces if b in p)
        if min(len(one), len(two)) >= M:
            total += len(left) * dense
            below = [best(p, [e for e in now if e[1] in p], dense) for p in (one, two)]
            worth, found = sum(w for w, _ in below), [c for _, cs in below for c in cs]
            own = total - len(points) * birth
            return (worth, found) if root or worth > own else (own, [set(points)])
        if max(len(one), len(two)) < M:
            total += len(left) * dense
            own = total - len(points) * birth
            return (0.0, []) if root else (own, [set(points)])
        small, big = (one, two) if len(one) < len(two) else (two, one)
        total += len(small) * dense
        left, now = big, [e for e in now if e[1] in big]


def labels(x, k):
    edges, out = kruskal(reach(x, k)), {}
    for c in best(range(len(x)), edges, 0.0, root=True)[1]:
        out |= dict.fromkeys(c, min(c))
    return [out.get(i) for i in range(len(x))]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(8)
    blobs = np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in (([0, 0], 0.3, 50), ([3, 0], 0.2, 40), ([3.9, 0], 0.2, 30), ([0, 5], 0.5, 40))] + [r.uniform(-3, 8, (25, 2))])
    even = r.uniform(0, 1, (60, 2))
    even[50:] = even[40:50]  # equal vectors
    rows = [("a", i, v.tolist()) for i, v in enumerate(blobs)] + [("b", i, v.tolist()) for i, v in enumerate(even)]
    rows += [("c", 1, [0.0, 0.0]), ("a", 900, None), ("a", 901, [None, 1.0]), ("a", 902, [float("nan"), 1.0]), (None, 3, [1.0, 1.0])]
    return {"a": blobs, "b": even}, spark.createDataFrame(rows, "label string, n int, v array<double>").repartition(5)


def test_tree_as_by_sorting_all_pairs(data):
    xs, df = data
    got = trees.spanning_tree(df, "label", "n", "v", chunk=48).collect()
    for g, x in xs.items():
        own = [(r.w, r.a, r.b) for r in got if r.label == g]
        want = kruskal(reach(x, 0))
        assert len(own) == len(x) - 1 == len({(a, b) for _, a, b in own}) and len(parts(range(len(x)), own)) == 1
        assert sorted(w for w, _, _ in own) == pytest.approx(sorted(w for w, _, _ in want), abs=1e-7)
    assert not [r for r in got if r.label not in xs]


def test_clusters_as_from_the_top_down(data):
    xs, df = data
    got = {(r.label_, r.n): r.label for r in trees.density_clusters(df.withColumnRenamed("label", "label_"), "label_", "n", "v", least=M, k=5, chunk=64, size=37).collect()}
    assert len(got) == sum(map(len, xs.values())) + 1 and got["c", 1] is None
    for g, x in xs.items():
        assert [got[g, i] for i in range(len(x))] == labels(x, 5)
    assert {0, 50, 120, None} == {got["a", i] for i in range(185)}  # the second and third blob touch


def test_none(spark, data):
    df = data[1].withColumnRenamed("label", "label_")
    assert trees.density_clusters(df.limit(0), "label_", "n", "v").count() == 0
    with pytest.raises(ValueError):
        trees.density_clusters(df, "label_", "n", "v", least=1)


def test_blocks_are_compared_piece_by_piece(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    x[5] = x[6]
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, n long, v array<double>")
    for piece, chunk in ((16, 1 << 13), (7, 40)):
        monkeypatch.setattr(trees, "PIECE", piece)
        for k in (0, 4):
            got = sorted((r.w, r.a, r.b) for r in trees.spanning_tree(df, "g", "n", "v", k=k, chunk=chunk).collect())
            want = kruskal(reach(x, k))
            assert np.allclose([w for w, _, _ in got], [w for w, _, _ in want], atol=1e-7)
            assert k or {e[1:] for e in got} == {e[1:] for e in want}
    many = spark.range(5000).selectExpr("'a' AS g", "id", "array(0.0D) AS u")
    assert trees._dealt(many, trees.CHUNK).count() == 5000  # no copies: one chunk holds them
