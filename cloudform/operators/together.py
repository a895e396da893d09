"""Maps of groups too large for one task, over all pairs of their rows, by the tasks of one barrier stage together.

Each task reads a group's vectors, does the rows of its own share against all of them, and tells the others what came of
it: neighbours, lengths of ways, positions. Memory holds the vectors of a batch of groups and pieces of `PIECE` pairs;
what a task needs of its pairs again and again (probabilities of neighbours, squared lengths of ways) stands in a file of
its own. The work is quadratic in a group's rows, as all pairs count, and every task has the same part of each group.
"""

from __future__ import annotations

import secrets
import socket
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

from ..sources.arrays import located
from .cloud import column_matrix

PIECE = 1 << 18  # pairs that are held at once
HUB = 64  # edges of a vertex that are followed with those of all others; of copies of one vector a few have the edges of all
PATIENCE = 300  # seconds for a task's call to the first
BATCH = 1 << 16  # rows of the groups that go through one stage, but for a single group that has more


class Team:
    """The tasks of a barrier stage, joined by sockets to the first of them. Without a context, one task that is its own team.

    The barrier itself tells the first task's port and a word that callers must know; it is too slow (a second a call)
    for the rounds. A task that fails closes its socket, so that all fail and Spark runs the stage again.
    """

    def __init__(self, context: BarrierTaskContext | None = None):
        self.me, self.all, self.peers = 0, 1, []
        if context is None:
            return
        self.me, self.all = context.partitionId(), len(context.getTaskInfos())
        if self.me:
            port, word = context.allGather()[0].split()
            peer = socket.create_connection((context.getTaskInfos()[0].address.rsplit(":", 1)[0], int(port)), PATIENCE)
            peer.sendall(word.encode() + struct.pack("<q", self.me))
            self.peers = [peer]
        else:
            with socket.create_server(("", 0), backlog=self.all) as server:
                word, known = secrets.token_hex(16), {}
                context.allGather(f"{server.getsockname()[1]} {word}")
                server.settimeout(PATIENCE)
                while len(known) < self.all - 1:
                    peer, _ = server.accept()
                    peer.settimeout(PATIENCE)
                    hello = self.received(peer, len(word) + 8)
                    if secrets.compare_digest(hello[: len(word)], word.encode()):
                        known[struct.unpack("<q", hello[len(word) :])[0]] = peer
                    else:
                        peer.close()
            self.peers = [known[t] for t in range(1, self.all)]
        for peer in self.peers:
            peer.settimeout(None)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def received(peer: socket.socket, size: int) -> bytearray:
        out, at = bytearray(size), 0
        while at < size:
            more = peer.recv_into(memoryview(out)[at:])
            if not more:
                raise ConnectionError("another task of the stage is gone")
            at += more
        return out

    def message(self, peer: socket.socket) -> bytearray:
        return self.received(peer, *struct.unpack("<q", self.received(peer, 8)))

    def share(self, n: int, task: int | None = None) -> tuple[int, int]:
        task = self.me if task is None else task
        return n * task // self.all, n * (task + 1) // self.all

    def gathered(self, part: np.ndarray) -> np.ndarray:
        """The parts of all tasks, one after the other."""
        if not self.peers:
            return part
        mine = np.ascontiguousarray(part).tobytes()
        if self.me:
            self.peers[0].sendall(struct.pack("<q", len(mine)) + mine)
            whole = self.message(self.peers[0])
        else:
            whole = b"".join([mine, *map(self.message, self.peers)])
            for peer in self.peers:
                peer.sendall(struct.pack("<q", len(whole)))
                peer.sendall(whole)
        many = len(whole) // (part.dtype.itemsize * int(np.prod(part.shape[1:])))
        return np.frombuffer(whole, part.dtype, many * int(np.prod(part.shape[1:]))).reshape(many, *part.shape[1:])

    def told(self, value: np.ndarray) -> np.ndarray:
        """The first task's value, so that rounding on other machines decides nothing."""
        return self.gathered(value if self.me == 0 else value[:0])

    def __enter__(self) -> Team:
        return self

    def __exit__(self, *_) -> None:
        for peer in self.peers:
            peer.close()


class Spool:
    """Matrices in a file of the task's own, written once and read in their order again and again."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def add(self, a: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(a).reshape(-1).view(np.uint8).data)

    def rewind(self) -> None:
        self.file.seek(0)

    def next(self, shape: tuple[int, int], kind) -> np.ndarray:
        out = np.empty(shape, kind)
        if self.file.readinto(out.reshape(-1).view(np.uint8).data) != out.nbytes:
            raise OSError("a task's own file is shorter than what was written")
        return out

    def __enter__(self) -> Spool:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def pieces(low: int, high: int, n: int, held: int = PIECE):
    step = max(1, held // max(n, 1))
    for a in range(low, high, step):
        yield a, min(a + step, high)


class Points:
    """Rows of a matrix and their squared distances: by products, and from differences where rounding could decide."""

    def __init__(self, x: np.ndarray):
        self.raw, self.x = x, x - x.mean(0)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.slack = 1e-12 * self.sq.max(initial=0)

    def __len__(self) -> int:
        return len(self.x)

    def between(self, a: int, b: int) -> np.ndarray:
        d = self.x[a:b] @ self.x.T
        d *= -2
        d += self.sq
        d += self.sq[a:b, None]
        return np.maximum(d, 0, out=d)

    def levels(self, a: int, b: int) -> np.ndarray:
        """between, in steps above its rounding, so that distances to copies of one vector are the same."""
        step = max(self.slack, 1e-300)
        d = self.between(a, b)
        d /= step
        return np.multiply(np.rint(d, out=d), step, out=d)

    def others(self, a: int, b: int) -> np.ndarray:
        d = self.between(a, b)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        return d

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for a, b in pieces(0, len(i), self.x.shape[1]):
            gap = self.raw[i[a:b]] - self.raw[j[a:b]]
            out[a:b] = (gap * gap).sum(1)
        return out


def nearest(points: Points, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the k nearest others of the rows low to high, ties by place."""
    to, far = np.empty((high - low, k), np.int64), np.empty((high - low, k))
    for a, b in pieces(low, high, len(points)):
        d = points.others(a, b)
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + points.slack)
        true = points.exact(a + row, col)
        order = np.lexsort((col, true, row))
        row, col, true = row[order], col[order], true[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        to[a - low : b - low], far[a - low : b - low] = col[first].reshape(-1, k), true[first].reshape(-1, k)
    return to, far


def trusts(points: Points, maps: list[np.ndarray], team: Team, k: int = 5) -> list[float | None]:
    """The trustworthiness of each map, as projections.trustworthiness has it."""
    n = len(points)
    k = min(k, (n - 1) // 2)
    if k < 1 or 2 * n - 3 * k - 1 <= 0:
        return [None] * len(maps)
    low, high = team.share(n)
    near = np.concatenate([nearest(Points(y), low, high, k)[0] for y in maps], 1)
    over = np.zeros((1, near.shape[1]))
    for a, b in pieces(low, high, n):
        d, mine = points.others(a, b), near[a - low : b - low]
        for c in range(near.shape[1]):
            far = points.exact(np.arange(a, b), mine[:, c])
            rank = 1 + np.count_nonzero(d < (far - points.slack)[:, None], axis=1)
            row, col = np.nonzero(np.abs(d - far[:, None]) <= points.slack)
            true = points.exact(a + row, col)
            rank += np.bincount(row[(true < far[row]) | ((true == far[row]) & (col < mine[row, c]))], minlength=b - a)
            over[0, c] += np.maximum(rank - k, 0).sum()
    over = team.gathered(over).sum(0).reshape(len(maps), k).sum(1)
    return [float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * v) for v in over]


# ---------------------------------------------------------------- isomap
def parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each vertex the least vertex that edges join it to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def graph(points: Points, k: int, team: Team) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, length), i < j, to the k nearest, and the shortest ones that join what these leave apart."""
    n = len(points)
    low, high = team.share(n)
    to, far = nearest(points, low, high, min(k, n - 1))
    to, far = team.gathered(to), team.gathered(far)
    i, j = np.repeat(np.arange(n), to.shape[1]), to.ravel()
    edges = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0)
    label = parts(n, *edges.T)
    while label.any():  # Boruvka: of each part the shortest edge out of it
        best: dict[int, tuple[float, int, int]] = {}
        for a, b in pieces(low, high, n):
            d = points.between(a, b)
            d[label[a:b, None] == label] = np.inf
            at, out = np.arange(a, b), d.argmin(1)
            for part, *edge in zip(label[at].tolist(), points.exact(at, out).tolist(), np.minimum(at, out).tolist(), np.maximum(at, out).tolist(), strict=True):
                best[part] = min(best.get(part, (np.inf, 0, 0)), tuple(edge))
        whole: dict[int, tuple[float, int, int]] = {}
        for part, *edge in team.gathered(np.array([(p, *e) for p, e in best.items()], float).reshape(-1, 4)).tolist():
            whole[part] = min(whole.get(part, (np.inf, 0, 0)), tuple(edge))
        edges = np.unique(np.concatenate([edges, np.array([e[1:] for e in whole.values()], np.int64)]), axis=0)
        label = parts(n, *edges.T)
    i, j = edges.T
    return i, j, np.sqrt(points.exact(i, j))


def ways(n: int, i: np.ndarray, j: np.ndarray, length: np.ndarray, low: int, high: int):
    """(a, b, lengths of the shortest ways from the vertices a to b to all others) for the vertices low to high."""
    i, j, length = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([length, length])
    degree = np.bincount(i, minlength=n)
    by = np.argsort(-degree, kind="stable")  # vertices of many edges come first, so the s-th edges are those of a first stretch
    at = np.empty(n, np.int64)
    at[by] = np.arange(n)
    order = np.lexsort((length, at[i]))
    start, to, length = np.cumsum(degree[by]) - degree[by], at[j[order]], length[order]
    slots = []
    for s in range(min(degree.max(initial=0), HUB)):
        e = start[: np.count_nonzero(degree > s)] + s
        slots.append((to[e], length[e][:, None]))
    hubs = [(v, slice(start[v] + HUB, start[v] + degree[by[v]])) for v in range(np.count_nonzero(degree > HUB))]
    for a, b in pieces(low, high, n):
        way = np.full((n, b - a), np.inf)
        way[at[a:b], np.arange(b - a)] = 0
        while True:
            before = way.copy()
            for ends, long in slots:
                part = way[: len(ends)]
                step = way[ends]
                step += long
                np.minimum(part, step, out=part)
            for v, e in hubs:
                np.minimum(way[v], (way[to[e]] + length[e, None]).min(0), out=way[v])
            if (before == way).all():
                break
        yield a, b, way[at].T


def isomap(points: Points, start: np.ndarray, team: Team, k: int = 10, most: int = 500) -> np.ndarray:
    """Classical scaling of the lengths of shortest ways: the two leading eigenvectors from a Krylov space, four a pass."""
    n = len(points)
    low, high = team.share(n)
    with Spool() as squares:
        for _, _, way in ways(n, *graph(points, k, team), low, high):
            squares.add(way * way)

        def product(v: np.ndarray) -> np.ndarray:
            squares.rewind()
            out = [squares.next((b - a, n), np.float64) @ v for a, b in pieces(low, high, n)]
            out = team.gathered(np.concatenate([np.zeros((0, v.shape[1])), *out]))
            return -0.5 * (out - out.mean(0))

        v, image = np.zeros((n, 0)), np.zeros((n, 0))
        new = np.concatenate([start, np.random.default_rng(0).normal(size=(n, 2))], 1)
        new = new - new.mean(0)
        for _ in range(most):
            for _ in range(2):  # once leaves rounding
                new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
                new = new - v @ (v.T @ new)
                new = new - new.mean(0)
            q, r = np.linalg.qr(new)
            new = team.told(np.ascontiguousarray(q * (np.abs(np.diag(r)) > 1e-10)))  # what is in the space already counts as nothing
            v, image = np.concatenate([v, new], 1), np.concatenate([image, product(new)], 1)
            small = v.T @ image
            w, s = np.linalg.eigh((small + small.T) / 2)
            w, s = w[::-1], s[:, ::-1]
            rest = image @ s[:, :2] - v @ s[:, :2] * w[:2]
            done = np.linalg.norm(rest, axis=0).max() <= 1e-10 * max(abs(w[0]), 1e-300) or not new.any()
            if team.told(np.array([done]))[0]:
                break
            new = image[:, -new.shape[1] :] - v @ small[:, -new.shape[1] :]
            if v.shape[1] >= 40:
                v, image = v @ s[:, :12], image @ s[:, :12]
    return v @ s[:, :2] * np.sqrt(np.maximum(w[:2], 0))


# ---------------------------------------------------------------- t-distributed neighbours
def widths(d: np.ndarray, own: np.ndarray, perplexity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, beta, total) of rows of squared distances d, own the place of each row itself: the others' probabilities
    exp(-(d - least) beta) / total have the perplexity. Newton's steps, halving where they leave what is known."""
    at, want = np.arange(len(d)), np.log(perplexity)
    beta = 1 / np.maximum(np.median(d, 1), 1e-12)
    d = d.copy()
    d[at, own] = np.inf
    least = d.min(1)
    d -= least[:, None]
    d[at, own] = 0
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    for _ in range(60):
        p = np.exp(d * -beta[:, None])
        p[at, own] = 0
        total = p.sum(1)
        p *= d
        mean = p.sum(1) / total
        over = np.log(total) + beta * mean - want
        if (np.abs(over) <= 1e-12).all():
            break
        low, high = np.where(over > 0, beta, low), np.where(over > 0, high, beta)
        spread = np.einsum("ij,ij->i", p, d) / total - mean**2
        with np.errstate(all="ignore"):
            newton = beta + over / (beta * spread)
        halved = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        beta = np.where((newton > low) & (newton < np.minimum(high, beta * 4)), newton, halved)
    p = np.exp(d * -beta[:, None])
    p[at, own] = 0
    return least, beta, p.sum(1)


def probabilities(points: Points, perplexity: float, team: Team, out: Spool) -> None:
    """The task's rows of the symmetric probabilities of neighbours, in pieces."""
    n = len(points)
    low, high = team.share(n)
    mine = [np.stack(widths(points.levels(a, b), np.arange(a, b), perplexity), 1) for a, b in pieces(low, high, n)]
    least, beta, total = team.gathered(np.concatenate([np.zeros((0, 3)), *mine])).T
    for a, b in pieces(low, high, n):
        d = points.levels(a, b)
        p = np.exp(np.minimum((d - least[a:b, None]) * -beta[a:b, None], 0)) / total[a:b, None]
        d -= least
        d *= -beta
        p += np.exp(np.minimum(d, 0, out=d), out=d) / total
        p[np.arange(b - a), np.arange(a, b)] = 0
        out.add(np.maximum(p / (2 * n), 1e-12).astype(np.float32))


def forces(y: np.ndarray, low: int, high: int, probable: Spool) -> tuple[np.ndarray, float]:
    """Of the rows low to high: (pull by p w, push by w²) as four columns, and the sum of w = 1 / (1 + distance²) over their pairs."""
    n, z = len(y), y.astype(np.float32)
    sums = np.concatenate([np.ones((n, 1), np.float32), z], 1)
    out, total = np.empty((high - low, 4)), 0.0
    for a, b in pieces(low, high, n):
        p = probable.next((b - a, n), np.float32)
        w = z[a:b, :1] - z[:, 0]
        w *= w
        gap = z[a:b, 1:] - z[:, 1]
        gap *= gap
        w += gap
        w += 1
        np.reciprocal(w, out=w)
        total += float(w.sum(1).sum(dtype=np.float64)) - (b - a)
        p *= w
        pull = p @ sums
        w *= w
        push = w @ sums
        out[a - low : b - low, :2] = pull[:, :1] * z[a:b] - pull[:, 1:]
        out[a - low : b - low, 2:] = push[:, :1] * z[a:b] - push[:, 1:]
    return out, total


def tsne(groups: list[Points], starts: list[np.ndarray], team: Team, perplexity: float = 30.0, rounds: int = 500, rate: float = 200.0) -> list[np.ndarray]:
    """t-distributed neighbour embedding of several groups in step, all pairs, from their principal planes."""
    spools = [Spool() for _ in groups]
    for points, spool in zip(groups, spools, strict=True):
        probabilities(points, min(perplexity, (len(points) - 1) / 3), team, spool)
    y = [s / max(s[:, 0].std(), 1e-12) * 1e-4 for s in starts]
    shares = [team.share(len(s)) for s in starts]
    move = [np.zeros((b - a, 2)) for a, b in shares]
    gain = [np.ones((b - a, 2)) for a, b in shares]
    for i in range(rounds):
        mine, total = [], np.empty((1, len(groups)))
        for g, spool in enumerate(spools):
            spool.rewind()
            found, total[0, g] = forces(y[g], *shares[g], spool)
            mine.append(found)
        total = team.gathered(total).sum(0)
        for g, (a, b) in enumerate(shares):
            grad = 4 * ((12 if i < 100 else 1) * mine[g][:, :2] - mine[g][:, 2:] / total[g])
            gain[g] = np.maximum(np.where(grad * move[g] > 0, gain[g] * 0.8, gain[g] + 0.2), 0.01)
            move[g] = (0.5 if i < 100 else 0.8) * move[g] - min(rate, len(y[g]) / 3 + 10) * gain[g] * grad
            mine[g] = y[g][a:b] + move[g]
        told = team.gathered(np.concatenate(mine))
        at = 0
        for task in range(team.all):
            for g in range(len(groups)):
                a, b = team.share(len(y[g]), task)
                y[g][a:b] = told[at : at + b - a]
                at += b - a
        for g in range(len(groups)):
            y[g] -= y[g].mean(0)
    for spool in spools:
        spool.file.close()
    return y


# ---------------------------------------------------------------- the stage
def slots(spark: SparkSession) -> int:
    """Tasks that can run at once: a barrier stage starts all of its tasks or none."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def batches(sizes: list[int], held: int = BATCH) -> list[list[int]]:
    """Places of groups that go through one stage."""
    out, many = [], held
    for at, n in enumerate(sizes):
        if many + n > held:
            out.append([])
            many = 0
        out[-1].append(at)
        many += n
    return out


def maps(groups: list[np.ndarray], methods: tuple[str, ...], team: Team, plane, signs) -> list[dict[str, tuple[np.ndarray, float | None]]]:
    """For each group and method the map and its trustworthiness. plane: the principal plane; signs: fixes those of columns."""
    points = [Points(x) for x in groups]
    starts = [team.told(np.ascontiguousarray(plane(x))) for x in groups]
    out: list[dict] = [{} for _ in groups]
    for g, start in enumerate(starts):
        for m in methods:
            if m in ("pca", "mds"):  # scaling the distances of vectors themselves gives their principal plane
                out[g][m] = start
            elif m == "isomap":
                out[g][m] = signs(isomap(points[g], start, team))
    if "tsne" in methods:
        for g, y in enumerate(tsne(points, [s.copy() for s in starts], team)):
            out[g]["tsne"] = y
    for g in range(len(groups)):
        out[g] = dict(zip(out[g], zip(out[g].values(), trusts(points[g], list(out[g].values()), team), strict=True), strict=True))
    return out


def stage(rows: DataFrame, kind: str, methods: tuple[str, ...], plane, signs) -> DataFrame:
    """(g, method, id, x, y, n, trustworthiness) of the written table rows(g, id, v), by one barrier stage."""
    spark = rows.sparkSession
    files, many = sorted(rows.inputFiles()), slots(spark)

    def run(numbers):
        for _ in numbers:  # one a task, of no meaning
            pass
        with Team(BarrierTaskContext.get()) as team:
            t = []
            for f in files:
                fs, p = located(f)
                with fs.open_input_file(p) as source:
                    t.append(pq.read_table(source))
            t = pa.concat_tables(t).sort_by([("g", "ascending"), ("id", "ascending")])
            keys = pc.unique(t.column("g")).to_pylist()
            tables = [t.filter(pc.equal(t.column("g"), k)) for k in keys]
            del t
            ids = [x.column("id").combine_chunks() for x in tables]
            for g, found in enumerate(maps([column_matrix(x, "v") for x in tables], methods, team, plane, signs)):
                n = len(ids[g])
                a, b = team.share(n)
                for m, (y, trust) in found.items():
                    for s, e in pieces(a, b, 1, 1 << 16):
                        size = e - s
                        yield pa.RecordBatch.from_pydict({"g": pa.array([keys[g]] * size, pa.int32()), "method": [m] * size, "id": ids[g].slice(s, size), "x": y[s:e, 0].copy(), "y": y[s:e, 1].copy(), "n": pa.array([n] * size, pa.int64()), "trustworthiness": pa.array([trust] * size, pa.float64())})

    return spark.range(0, many, 1, many).mapInArrow(run, f"g int, method string, id {kind}, x double, y double, n long, trustworthiness double", barrier=True)
