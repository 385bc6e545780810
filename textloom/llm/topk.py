"""Exact top-k search by inner product: columnar branch and bound.

Candidates lie in blocks in vertical layout. For one query a block is scored dimension block by dimension block, the
query's heaviest dimensions first. After each of them, a candidate stays only if its partial score and the largest that
the rest may add (the masses of what is left of query and candidate, by Cauchy and Schwarz) reach the k-th best score found
so far; the survivors are compacted, and those that reach the end have their exact score. Scores are integers, and doubles
hold them exactly; where magnitudes do not allow that, products are taken of Python integers instead.

Query blocks meet every candidate block in rounds: one block, one more, then two, four, and so on. Each round starts from
the k-th best scores of the rounds before, so it emits a bounded number of rows a query, and the number of rounds is the
logarithm of the number of blocks. Steps are written to the shared folder. Queries and candidates are stated sets, so the
work is their product; what any task holds is one block of each.

Vectors that are null, empty, or hold null, NaN or infinite components take no part. Vectors only meet those of the same
number of components. Equal rows (id and vector) count once; rows that share an id but not the vector are candidates of
each other. Rows without an id are no queries, and rank last among ties. Scores beyond the long range are its nearest end.
Other columns are not read; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import vectors
from textloom.llm.common import arrow, stored

BLOCK, QUERIES, INNER, STEP = 32_768, 128, 4_096, 8


def clipped(v: int) -> int:
    return min(max(v, int(vectors.LONG.min)), int(vectors.LONG.max))


def exact_scores(q: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of Python integers, at the ends of the long range beyond it."""
    total = (cols.astype(object) * q.astype(object)[:, None]).sum(0)
    return np.array([clipped(int(v)) for v in total], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, ties to the smaller id."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near].astype(object) if score[near].min() == vectors.LONG.min else -score[near]))][:k]
    return np.lexsort((ids, -score.astype(object) if len(score) and score.min() == vectors.LONG.min else -score))


def survivors(q: np.ndarray, weight: np.ndarray, cols: np.ndarray, mass: np.ndarray, least: float, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a block's candidates that reach ``least``; ``cols``: doubles, a row for each dimension, ``mass``: squared lengths."""
    order = np.argsort(-weight, kind="stable")
    rest = np.r_[np.cumsum((q[order] ** 2)[::-1])[::-1], 0.0]
    live, part, left = None, np.zeros(cols.shape[1]), mass
    for a in range(0, len(q), STEP):
        d = order[a:a + STEP]
        x = cols[d] if live is None else cols[np.ix_(d, live)]
        part = part + q[d] @ x
        if seen is not None:
            seen[0] += x.size
        if a + STEP < len(q) and least > -np.inf:
            left = left - np.einsum("ij,ij->j", x, x)
            keep = part + np.sqrt(np.maximum(left, 0) * rest[a + STEP]) * (1 + 1e-9) + 0.5 >= least
            if not keep.all():
                live = np.flatnonzero(keep) if live is None else live[keep]
                part, left = part[keep], left[keep]
    return (np.arange(cols.shape[1]) if live is None else live), part


def search_block(qs: np.ndarray, own: np.ndarray, floor: np.ndarray, cols: np.ndarray, ids: np.ndarray, k: int, seen: list | None = None):
    """For each query (a row of ``qs``) the places and scores of its k best candidates among those that reach ``floor``.

    ``own``: the query's id; a candidate of the same id and vector is the query itself.
    """
    dim, n = cols.shape
    exact = dim * float(vectors.top(qs)) * float(vectors.top(cols)) < vectors.EXACT and dim * float(vectors.top(cols)) ** 2 < vectors.EXACT
    parts = []
    for a in range(0, n, INNER):
        c = cols[:, a:a + INNER]
        x = c.astype(np.float64) if exact else c
        parts.append((a, x, (x * x).sum(0) if exact else None, np.sqrt((x * x).mean(1)) if exact else None))
    for i, (q, me) in enumerate(zip(qs, own)):
        lo, hi = np.searchsorted(ids, me), np.searchsorted(ids, me, "right")
        self_at = [p for p in range(lo, hi) if np.array_equal(cols[:, p], q)]
        at, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), floor[i]
        qf = q.astype(np.float64)
        for a, x, mass, rms in parts:
            if exact:
                p, s = survivors(qf, np.abs(qf) * rms, x, mass, float(least) if least is not None else -np.inf, seen)
                p, s = p + a, s.astype(np.int64)
            else:
                p, s = np.arange(a, a + x.shape[1]), exact_scores(q, x)
            ok = ~np.isin(p, self_at) if self_at else np.ones(len(p), bool)
            if least is not None:
                ok &= s >= least
            at, score = np.r_[at, p[ok]], np.r_[score, s[ok]]
            if len(at) > k:
                b = best(score, ids[at], k)
                at, score = at[b], score[b]
            if len(at) == k:
                least = int(score.min()) if least is None else max(least, int(score.min()))
        yield i, at, score


def _round(queries: DataFrame, blocks: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """``dim, g, at, query_id, vec_id, score``: what query blocks find in the given blocks; ``g`` and ``at`` name the query."""
    q = queries.select("dim", F.col("g").alias("qg"), F.col("ids").alias("qids"), F.col("width").alias("qwidth"), F.col("data").alias("qdata"))
    if floors is not None:
        q = q.join(floors, ["dim", "qg"], "left")
    else:
        q = q.withColumn("floors", F.lit(None).cast("array<struct<at:int,least:long>>"))
    # One row for each pair of blocks; a block is some thousands of vectors.
    pairs = blocks.select("dim", "g").join(q.select("dim", "qg"), "dim")
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(q, ["dim", "qg"]).join(blocks.select("dim", "g", "ids", "width", "data"), ["dim", "g"]).repartition(n, "dim", "qg", "g")

    def work(b):
        for r in range(b.num_rows):
            row = {c: b.column(c)[r].as_py() for c in b.schema.names}
            dim = row["dim"]
            qids, ids = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
            floor = np.full(len(qids), None, object)
            for f in row["floors"] or ():
                floor[f["at"]] = f["least"]
            out = {c: [] for c in ("at", "query_id", "vec_id", "score")}
            for i, at, score in search_block(vectors.wide(row["qdata"], row["qwidth"], dim).T, qids, floor, vectors.wide(row["data"], row["width"], dim), ids, k):
                out["at"].append(np.full(len(at), i))
                out["query_id"].append(np.full(len(at), qids[i]))
                out["vec_id"].append(ids[at])
                out["score"].append(score)
            out = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
            m = len(out["at"])
            yield {"dim": np.full(m, dim), "qg": np.full(m, row["qg"]), **out}

    return arrow(work, rows, "dim int, qg long, at int, query_id long, vec_id long, score long")


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, block: int = BLOCK, per: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of largest inner product of each query, itself left out.

    Both: vec_id, embedding (an array of numbers).
    """
    q = vectors.packed(vectors.usable(queries.where("vec_id is not null")), scale, per)
    c = vectors.packed(vectors.usable(candidates), scale, block)
    many = c.agg(F.max("g")).first()[0]
    ranked = Window.partitionBy("dim", "qg", "at").orderBy(F.desc("score"), "vec_id")
    found, floors, done, width = None, None, 0, 1
    while found is None or (many is not None and done <= many):
        new = _round(q, c.where(F.col("g").between(done, done + width - 1)), floors, k)
        every = new if found is None else found.drop("rank").unionByName(new)
        found = stored(every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        full = found.where(F.col("rank") == k).select("dim", "qg", F.struct(F.col("at"), F.col("score").alias("least")).alias("f"))
        floors = full.groupBy("dim", "qg").agg(F.collect_list("f").alias("floors"))  # at most the queries of one block
        done, width = done + width, max(1, done)
    none = F.when(F.col("vec_id") != vectors.LONG.max, F.col("vec_id"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), none.alias("vec_id"), "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The query: rows whose number is divisible by 20, against all rows."""
    return search(embeddings.where("vec_id % 20 = 0"), embeddings)
