"""Centroid clustering: Lloyd's rounds by two cover trees.

Vectors are dealt into blocks of some thousands by a hash; each block's cover tree is built once and stored with it. In
every round a cover tree over the centroids is built too, and pairs of nodes, one of each tree, are visited from the roots
down. A centroid's node is dropped for a vector's node when even its nearest centroid is farther from the nearest vector
than some other centroid is from the farthest one. When one centroid is left, the whole node goes to it and adds its stored
sums; where both nodes are leaves, vectors and centroids are compared exactly, in integers.

Nodes are points of their level's net with the exact radius of all points under them; a node's net has points more than
half its radius apart. A leaf holds at most ``LEAF`` points that nothing parts further.

Only k centroids and, for each task, k sums of components go through the driver. Sums and quotients are Python integers
there, so centroids are exact whatever the number of vectors. Blocks are written to the shared folder and read once a round.

Vectors that are null, or hold null, NaN or infinite components, or another number of components than asked for, take no
part. Rows that repeat count as often as they occur. Rows without an id hash as the text ``2:``, and ties of the hash go by
the vector. With fewer vectors than centroids asked for, there are as many centroids as vectors; an empty table gives an
empty result. Where squared distances could leave the exact range of doubles, a block is compared in Python integers, and
distances beyond the long range are its end. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import vectors
from textloom.llm.common import arrow, prepared, stored

BLOCK, LEAF = 2_048, 24
NEAR, FAR = 1 - 1e-9, 1 + 1e-9


class CoverTree:
    """Nodes in arrays, children of a node side by side; the points under a node are ``order[lo:hi]``."""

    FIELDS = ("point", "radius", "lo", "hi", "first", "many")

    def __init__(self, x: np.ndarray | None = None, leaf: int = LEAF, saved: dict | None = None):
        if saved is not None:
            self.__dict__.update(saved)
            return
        n = len(x)
        f = x.astype(np.float64)
        norm = (f * f).sum(1)
        order = np.arange(n)
        node = [[0, 0.0, 0, n, 0, 0]] if n else []
        at = 0
        while at < len(node):
            p, _, lo, hi, _, _ = node[at]
            under = order[lo:hi]
            dist = np.sqrt(np.maximum(norm[under] + norm[p] - 2 * (f[under] @ f[p]), 0)) * FAR
            dist[under == p] = 0
            radius = float(dist.max())
            node[at][1] = radius
            if hi - lo > leaf and radius > 0:
                # The net of half the radius: each point goes to the first net point within reach.
                rest, d, parts, net = under, dist, [], p
                while True:
                    near = d <= radius / 2
                    near |= rest == net
                    parts.append((net, rest[near]))
                    rest = rest[~near]
                    if not len(rest):
                        break
                    net = rest[0]
                    d = np.sqrt(np.maximum(norm[rest] + norm[net] - 2 * (f[rest] @ f[net]), 0)) * FAR
                if len(parts) > 1:
                    order[lo:hi] = np.concatenate([m for _, m in parts])
                    node[at][4:6] = len(node), len(parts)
                    for q, m in parts:
                        node.append([int(q), 0.0, lo, lo + len(m), 0, 0])
                        lo += len(m)
            at += 1
        cols = list(zip(*node)) if node else [()] * 6
        for name, c in zip(self.FIELDS, cols):
            setattr(self, name, np.array(c, np.float64 if name == "radius" else np.int32))
        self.order = order.astype(np.int32)


def _expand(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places of ``first[i], first[i] + 1, ...``, ``many[i]`` each."""
    row = np.repeat(np.arange(len(first)), many)
    return row, np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _squares(f: np.ndarray, c: np.ndarray, nf: np.ndarray, nc: np.ndarray, p: np.ndarray, k: np.ndarray, slab: int = 1 << 16) -> np.ndarray:
    """Squared distances of pairs of rows, some pairs at a time."""
    out = nf[p] + nc[k]
    for a in range(0, len(p), slab):
        out[a:a + slab] -= 2 * np.einsum("ij,ij->i", f[p[a:a + slab]], c[k[a:a + slab]])
    return out


def assign(x: np.ndarray, tree: CoverTree, centres: np.ndarray, stats: list | None = None) -> tuple[np.ndarray, list]:
    """Cluster of every point (ties: the smaller number), and ``(lo, hi, cluster)`` of the nodes assigned whole.

    Duals of nodes whose arithmetic is exact in doubles; see ``plain`` for others.
    """
    f, c = x.astype(np.float64), centres.astype(np.float64)
    nf, nc = (f * f).sum(1), (c * c).sum(1)
    other = CoverTree(centres, leaf=1)
    out = np.zeros(len(x), np.int32)
    whole: list = []
    # Pairs of a point node and a centre node; a "leaf" centre node is one whose points are not parted further.
    v, w = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        pv, pw = tree.point[v], other.point[w]
        d = np.sqrt(np.maximum(_squares(f, c, nf, nc, pv, pw), 0))
        if stats is not None:
            stats[0] += len(v)
        best = np.full(len(tree.point), np.inf)
        np.minimum.at(best, v, d * FAR + tree.radius[v])
        keep = d * NEAR - tree.radius[v] - other.radius[w] <= best[v]
        v, w = v[keep], w[keep]
        pairs = np.bincount(v, minlength=len(tree.point))
        wleaf, vleaf = other.many[w] == 0, tree.many[v] == 0
        single = other.hi[w] - other.lo[w] == 1
        # One centre is left: the node is its, whole.
        sure = single & (pairs[v] == 1)
        for a, b, k in zip(tree.lo[v[sure]], tree.hi[v[sure]], other.point[w[sure]]):
            out[tree.order[a:b]] = k
            whole.append((int(a), int(b), int(k)))
        # All centre nodes of a point leaf are leaves: compare its points exactly.
        open_w = np.bincount(v, weights=~wleaf, minlength=len(tree.point))
        exact = ~sure & vleaf & (open_w[v] == 0)
        if exact.any():
            ev, ew = v[exact], w[exact]
            row, at = _expand(other.lo[ew], other.hi[ew] - other.lo[ew])
            cv, ck = ev[row], other.order[at]
            row, at = _expand(tree.lo[cv], tree.hi[cv] - tree.lo[cv])
            p, k = tree.order[at].astype(np.int64), ck[row].astype(np.int64)
            if stats is not None:
                stats[1] += len(p)
            dist = _squares(f, c, nf, nc, p, k)  # integers below 2**52
            o = np.lexsort((k, dist, p))
            first = np.r_[True, p[o][1:] != p[o][:-1]]
            out[p[o][first]] = k[o][first]
        rest = ~sure & ~exact
        v, w = v[rest], w[rest]
        # Descend the wider of the two nodes, or both; a leaf stays as it is.
        vleaf, wleaf = tree.many[v] == 0, other.many[w] == 0
        down_v = ~vleaf & (wleaf | (tree.radius[v] >= other.radius[w]))
        # A point node goes down with all its pairs or with none, so that its centres stay together.
        together = np.bincount(v, weights=down_v, minlength=len(tree.point)) > 0
        down_v = ~vleaf & together[v]
        down_w = ~wleaf
        row, nv = _expand(np.where(down_v, tree.first[v], v), np.where(down_v, tree.many[v], 1))
        v, w, down_w = nv, w[row], down_w[row]
        row, nw = _expand(np.where(down_w, other.first[w], w), np.where(down_w, other.many[w], 1))
        v, w = v[row], nw
    return out, whole


def exact(x: np.ndarray, centres: np.ndarray) -> bool:
    """Whether squared distances fit doubles."""
    return x.shape[1] * float(vectors.top(x) + vectors.top(centres)) ** 2 < vectors.EXACT


def plain(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters and squared distances in Python integers."""
    c, out, dist = [[int(v) for v in r] for r in centres], [], []
    for p in x:
        p = [int(v) for v in p]
        d, k = min((sum((a - b) ** 2 for a, b in zip(p, q)), k) for k, q in enumerate(c))
        out.append(k)
        dist.append(min(d, int(vectors.LONG.max)))
    return np.array(out, np.int32), np.array(dist, np.int64)


STORED = "n int, ids binary, width int, data binary, top double, " + ", ".join(f"{c} binary" for c in (*CoverTree.FIELDS, "order"))


def trees(rows: DataFrame, scale: int, size: int, block: int) -> DataFrame:
    """A stored table of blocks of vectors, each with its cover tree."""
    prepared(rows.sparkSession)
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == size) & fine))
    many = max(1, -(-kept.count() // block))
    # Repeated rows have numbers of their own, by their place in the stored table, so no block holds all of a kind.
    dealt = kept.withColumn("g", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(many)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = vectors.integers(np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, size), scale)
        ids = table.column("vec_id").fill_null(vectors.LONG.max).to_numpy()
        t = CoverTree(x)
        data, width = vectors.narrow(x.T)
        cols = {"n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary()), "top": [float(vectors.top(x))]}
        return pa.table(cols | {c: pa.array([getattr(t, c).tobytes()], pa.binary()) for c in (*CoverTree.FIELDS, "order")})

    return stored(dealt.groupBy("g").applyInArrow(pack, STORED))


def _blocks(b: pa.RecordBatch, size: int):
    for r in range(b.num_rows):
        row = {c: b.column(c)[r].as_py() for c in b.schema.names}
        saved = {c: np.frombuffer(row[c], np.float64 if c == "radius" else np.int32) for c in (*CoverTree.FIELDS, "order")}
        yield np.frombuffer(row["ids"], np.int64), vectors.wide(row["data"], row["width"], size).T, CoverTree(saved=saved)


def first_centres(rows: DataFrame, k: int, scale: int, size: int, seed: str) -> np.ndarray:
    """The k vectors whose id hashes lowest, in the order of the hash."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("long").cast("string"), F.lit("")))
    own = rows.select(F.sha2(name, 256).alias("h"), v.alias("v")).where((F.size("v") == size) & fine)
    got = own.orderBy("h", "v").limit(k).collect()  # k rows
    return vectors.integers(np.array([r["v"] for r in got], np.float64).reshape(-1, size), scale)


def _sums(blocks: DataFrame, centres: np.ndarray, size: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of components for each cluster that has any."""
    shared = blocks.sparkSession.sparkContext.broadcast(centres)  # k vectors

    def work(b):
        c = shared.value
        for _, x, tree in _blocks(b, size):
            if exact(x, c):
                out, whole = assign(x, tree, c)
                upto = np.zeros((len(x) + 1, size), np.int64)
                np.cumsum(x[tree.order], axis=0, out=upto[1:])
                own = np.zeros((len(c), size), np.int64)
                count = np.bincount(out, minlength=len(c))
                left = np.ones(len(x), bool)
                for lo, hi, k in whole:  # whole nodes add their stored stretch
                    own[k] += upto[hi] - upto[lo]
                    left[lo:hi] = False
                at = tree.order[left]
                np.add.at(own, out[at], x[at].astype(np.int64))
            else:
                out, _ = plain(x, c)
                count = np.bincount(out, minlength=len(c))
                own = np.zeros((len(c), size), object)
                np.add.at(own, out, x.astype(object))
            used = np.flatnonzero(count)
            yield {"cluster": used, "n": count[used], "sums": pa.array([[str(v) for v in own[k]] for k in used.tolist()], pa.list_(pa.string()))}

    part = arrow(work, blocks, "cluster int, n long, sums array<string>")
    each = part.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got: dict = {}
    for r in each.collect():  # k times the number of components
        got.setdefault(r["cluster"], (r["n"], [0] * size))[1][r["i"]] = int(r["s"])
    shared.destroy()
    return got


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, size: int = 64, seed: str = "2", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` (squared) of every vector, and the final centroids."""
    centres = first_centres(rows, k, scale, size, seed)
    blocks = trees(rows, scale, size, block)
    for _ in range(rounds if len(centres) else 0):
        for i, (n, total) in _sums(blocks, centres, size).items():
            centres[i] = [v // n for v in total]
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def work(b):
        c = shared.value
        for ids, x, tree in _blocks(b, size):
            if exact(x, c):
                out, _ = assign(x, tree, c)
                dist = ((x.astype(np.int64) - c[out]) ** 2).sum(1)
            else:
                out, dist = plain(x, c)
            yield {"vec_id": pa.array(ids, mask=ids == vectors.LONG.max), "cluster": out, "distance": dist}

    return arrow(work, blocks, "vec_id long, cluster int, distance long"), [[int(v) for v in c] for c in centres]


def report(embeddings: DataFrame) -> DataFrame:
    """The query: every vector's cluster, its distance, the inertias and its centroid's digest."""
    spark = embeddings.sparkSession
    found, centres = cluster(embeddings)
    found = stored(found)
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centres)], "cluster int, name string").select("cluster", F.sha2("name", 256).alias("centroid_sha256"))
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(int(vectors.LONG.max)).cast("decimal(38,0)"))
    per = found.groupBy("cluster").agg(total("distance").alias("sum"))
    per = per.join(names, "cluster").crossJoin(F.broadcast(per.agg(total("sum").cast("long").alias("inertia"))))  # k rows by one row
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", F.col("sum").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
