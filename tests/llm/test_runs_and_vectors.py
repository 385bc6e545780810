"""Periodic runs, centroid clustering and top-k search against plain Python and SQL."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import lloyd, periodic, queries, topk, vectors

DATA = "/root/testdata/sf0.001"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- runs -----------------------------------------------------------------------------------------

def runs(w):
    """Every period's stretches, least periods only."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            t = w[s:i + q]
            if i > s and len(t) >= max(12, 2 * q) and not any(t[d:] == t[:-d] for d in range(1, q)):
                out.append((s, len(t), q))
            i += 1
    return sorted(out)


def expected(doc_id, text):
    w = [x for x in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text or "").split(" ") if x]
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = runs(w)
    gone = {i for s, n, q in r for i in range(s + q, s + n)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None
    return (doc_id, len(r), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in r)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=20), st.lists(st.integers(0, 2), min_size=1, max_size=17), st.integers(1, 8), st.lists(st.integers(0, 2), max_size=40))
def test_runs_of_repeats(head, body, times, tail):
    w = head + body * times + tail
    assert periodic.runs_of(periodic.numbers(w)) == runs(w)


@pytest.mark.parametrize("period", [5, 6, 7, 14, 15, 16, 30, 31, 62, 63, 100])
@pytest.mark.parametrize("shift", range(9))
def test_shortest_run_of_each_scale(period, shift):
    """A run of just two periods (or twelve words) is found wherever it starts."""
    body = [f"b{i}" for i in range(period)]
    n = max(12, 2 * period)
    w = [f"h{i}" for i in range(shift)] + (body * 3)[:n] + ["x", "y"]
    assert periodic.runs_of(periodic.numbers(w)) == [(shift, n, period)]
    assert periodic.runs_of(periodic.numbers(w[:shift + n - 1])) == []


def test_long_periodic_texts_take_no_square_of_their_length():
    w = ["a"] * 150_000
    assert periodic.runs_of(periodic.numbers(w)) == [(0, 150_000, 1)]


def _ids(rest):
    return [d for d in range(4000) if (zlib.crc32(str(d).encode()) % 10 == 0) == rest]


def test_runs_query(spark):
    line = "these eight words make a line of text"
    texts = ["", None, " \t\n", "w", "a " * 40, "a b " * 5 + "\x0b\x0c" + "c d e " * 4, "\n".join([line] * 6) + " end", "x y " * 13, "  " * 14,
             " ".join(f"w{i * i % 97}" for i in range(900)), " ".join(f"u{i}" for i in range(500)), "no run here at all"]
    rows = [(d, t) for ids in (_ids(True)[:40], _ids(False)[:40]) for d, t in zip(ids, texts * 4)] + [(None, "b " * 13), (7, "q " * 30), (7, "q " * 30), (-5, "z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1))
    got = sorted((tuple(r)[:8] for r in periodic.report(docs).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert periodic.report(docs.limit(0)).count() == 0


def test_runs_query_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 4000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r)[:8] for r in queries.periodic.report(docs).collect())
    assert got == sorted(expected(*r) for r in rows) and sum(r[1] for r in got) > 10


def test_collapse_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9 + "end", "en"), (2, "plain  text", None), (3, None, "de")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in periodic.collapse(docs).collect()) == [(1, "a b c end", "en"), (2, "plain  text", None), (3, None, "de")]


# ---- vectors --------------------------------------------------------------------------------------

def near(score, rows, k):
    return sorted(rows, key=lambda r: (-score(r), r[0]))[:k]


def brute_search(rows, k, scale):
    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, a in v:
        if i is None or i % 20:
            continue
        rest = [(j, sum(x * y for x, y in zip(a, b))) for j, b in v if len(b) == len(a) and (j, b) != (i, a)]
        rest.sort(key=lambda r: (-max(min(r[1], 2 ** 63 - 1), -2 ** 63), r[0] is None, r[0] or 0))
        out += [(i, n + 1, j, max(min(s, 2 ** 63 - 1), -2 ** 63)) for n, (j, s) in enumerate(rest[:k])]
    return sorted(out, key=repr)


ODD = [(20, None), (40, []), (60, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (120, [0.5, 0.5]), (121, [0.25, -4.0])]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("g", F.lit("clash")).withColumn("ids", F.lit("clash"))


def test_search_on_ties_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = ODD + [(i, [float(x) for x in rng.integers(-2, 3, 3) / 64]) for i in range(200, 700)]  # few values: many ties
    df = table(spark, rows)
    want = brute_search(rows, 7, 64)
    for block, per in ((32_768, 128), (60, 5)):
        got = topk.search(df.where("vec_id % 20 = 0"), df, 7, 64, block, per)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    twice = df.unionByName(df)  # equal rows count once
    assert sorted((tuple(r) for r in topk.search(df.where("vec_id % 20 = 0"), twice, 7).collect()), key=repr) == want
    assert topk.report(df.limit(0)).count() == 0 and topk.search(df.limit(0), df).count() == 0


def test_search_beyond_doubles(spark):
    rows = [(20 * i, [1e17 * (i - 3), 3.0 + i, -1e18]) for i in range(8)] + [(1, [9e18, 9e18, 9e18]), (2, [-9e30, 1.0, 1.0])]
    df = table(spark, rows)
    v = [(i, [max(min(math.floor(64 * x), 2 ** 63 - 1), -2 ** 63) for x in e]) for i, e in rows]
    want = brute_search([(i, [x for x in e]) for i, e in v], 4, 1)
    got = topk.search(df.where("vec_id % 20 = 0"), df, 4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_branch_and_bound_scores_a_part_of_the_components():
    """On clustered vectors most candidates leave before their last dimension, and results are those of a full scan."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 64)) * 200
    x = (centre[rng.integers(0, 12, 20_000)] + rng.normal(size=(20_000, 64)) * 30).astype(np.int64)
    ids, seen = np.arange(20_000), [0]
    q = np.arange(0, 20_000, 400)
    for i, at, score in topk.search_block(x[q], ids[q], np.full(len(q), None, object), np.ascontiguousarray(x.T), ids, 20, seen):
        s = x @ x[q[i]]
        s[q[i]] = -10 ** 15
        assert sorted(zip(-score, at)) == sorted(zip(-s, ids))[:20]
    share = seen[0] / (len(q) * x.size)
    print(f"components read: {share:.3f}")
    assert share < 0.6


def test_search_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    for name in ("op12_dual_tree_lloyd", "op13_branch_bound_topk"):
        got = queries.queries()[name](spark, DATA)
        want = con.execute(queries.oracle_sql()[name]).df()
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))


# ---- clustering -----------------------------------------------------------------------------------

def brute_cluster(rows, k, rounds, scale, size):
    v = [(i, tuple(math.floor(scale * x) for x in e)) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    raw = {id(r): r for r in v}
    first = sorted(raw.values(), key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    c = [list(r[1]) for r in first]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, q in enumerate(c))
    for _ in range(rounds):
        own = [near(p)[1] for _, p in v]
        for j in range(len(c)):
            m = [p for (_, p), o in zip(v, own) if o == j]
            if m:
                c[j] = [sum(col) // len(m) for col in zip(*m)]
    return sorted(((i, near(p)[1], min(near(p)[0], 2 ** 63 - 1)) for i, p in v), key=repr), c


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_clusters(spark, spread):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 4))
    rows = [(i, [float(x) for x in centre[i % 6] + rng.normal(size=4) * spread]) for i in range(700)] + [(i, [0.5] * 4) for i in range(700, 900)]  # one common vector
    rows += rows[:5] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 4), (1003, [None, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 2.0])]
    df = table(spark, rows)
    want, c = brute_cluster(rows, 9, 5, 256, 4)
    for block in (2048, 64):
        got, centres = lloyd.cluster(df, 9, 5, 256, 4, "2", block)
        assert centres == c
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_clusters_of_few_or_no_rows_and_beyond_doubles(spark):
    rows = [(1, [1e9, 2.0]), (2, [-3e12, 1.0]), (3, [1e9, 2.0])]
    got, c = lloyd.cluster(table(spark, rows), 40, 5, 256, 2)
    want, d = brute_cluster(rows, 40, 5, 256, 2)
    assert c == d and sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert lloyd.report(table(spark, rows)).count() == 0  # none has 64 components
    assert lloyd.report(table(spark, rows).limit(0)).count() == 0


def test_trees_prune_and_agree():
    """On clustered vectors whole nodes go to a centroid: far fewer distances than vectors times centroids."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 8)) * 1000
    x = np.floor(centre[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8)) * 20).astype(np.int64)
    c = np.floor(centre).astype(np.int64)
    stats = [0, 0]
    tree = lloyd.CoverTree(x)
    got, whole = lloyd.assign(x, tree, c, stats)
    assert (got == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    print(f"pairs of nodes {stats[0]}, exact pairs {stats[1]}, of {x.shape[0] * len(c)}")
    assert sum(stats) < x.shape[0] * len(c) / 10 and sum(b - a for a, b, _ in whole) > 1900
    for i in range(len(tree.point)):  # radii hold for all points under a node
        under = tree.order[tree.lo[i]:tree.hi[i]]
        assert np.sqrt(((x[under] - x[tree.point[i]]) ** 2).sum(1)).max() <= tree.radius[i]


def test_saturation():
    assert vectors.integers(np.array([1e300, -1e300, 0.7, -0.7]), 64).tolist() == [2 ** 63 - 1, -2 ** 63, 44, -45]
