"""Ranks, quantiles and p-values against plain Python; trees by pointer doubling."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.operators import metrics, significance, stats


def test_one_group_of_all_rows_is_spread_over_tasks(spark, monkeypatch):
    seen, write = [], stats.staged
    monkeypatch.setattr(stats, "staged", lambda df: seen.append(write(df)) or seen[-1])
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    for k in keep:
        spark.conf.set(k, "16k")
    try:
        rng = random.Random(3)
        values = [round(rng.gauss(0, 3), 3) for _ in range(40_000)] + [1.5] * 20_000 + [0.0] * 5000  # one value held by a third of the rows
        df = spark.createDataFrame([("all", v) for v in values], "g string, v double")
        got = stats.quantiles(df, ["g"], "v", q1=0.25, med=0.5, q3=0.75).first()
        want = statistics.quantiles(values, n=4, method="inclusive")
        assert [got["q1"], got["med"], got["q3"]] == pytest.approx(want, abs=1e-9) and got["n"] == len(values)
        held = [r["count"] for r in next(x for x in seen if "_p" in x.columns).groupBy("_p").count().collect()]
        assert len(held) > 2 and max(held) < 0.6 * sum(held)  # rows are distinct values: the frequent one is a single row
        r = stats.signed_ranks(df, ["g"], "v").first()
        assert tuple(r)[1:3] == (len(values), statistics.median(values))
        assert (r["n"], r["w_plus"], r["w_minus"]) == pytest.approx(rank_sums(values))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def rank_sums(deltas):
    d = sorted((x for x in deltas if x), key=abs)
    plus = minus = i = 0
    while i < len(d):
        j = i
        while j < len(d) and abs(d[j]) == abs(d[i]):
            j += 1
        rank = (i + 1 + j) / 2
        plus += rank * sum(x > 0 for x in d[i:j])
        minus += rank * sum(x < 0 for x in d[i:j])
        i = j
    return len(d), plus, minus


def ranks_of(deltas):
    m = sorted(abs(x) for x in deltas if x)
    return [(m.index(abs(x)) + 1 + m.index(abs(x)) + m.count(abs(x))) / 2 for x in deltas if x]


def pattern_p(deltas, side):
    """Over all sign patterns."""
    r = ranks_of(deltas)
    _, plus, _ = rank_sums(deltas)
    sums = [sum(x for x, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(r))]
    hi, lo = sum(s >= plus for s in sums) / len(sums), sum(s <= plus for s in sums) / len(sums)
    return {"greater": hi, "less": lo, "two-sided": min(1.0, 2 * min(hi, lo))}[side]


@pytest.mark.parametrize("side", ["greater", "less", "two-sided"])
def test_p_over_all_sign_patterns(spark, side):
    rng = random.Random(1)
    groups = {f"g{i}": [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 1.0, 3.0, rng.random()]) for _ in range(rng.randrange(0, 12))] for i in range(14)}
    groups["same"] = [1.0] * 8
    groups["zeros"] = [0.0, 0.0]
    rows = [(g, x) for g, d in groups.items() for x in d]
    got = {r["g"]: r["p"] for r in stats.with_p(stats.signed_ranks(spark.createDataFrame(rows, "g string, delta double"), ["g"], small=50), side).collect()}
    for g, d in groups.items():
        if any(d):
            assert got[g] == pytest.approx(pattern_p(d, side), abs=1e-12), (g, d)
        elif d:
            assert got[g] is None


def test_normal_tail(spark):
    z = [-9.0, -3.0, -2.9999, -0.5, 0.0, 0.1, 1.96, 2.999, 3.0, 5.0, 12.0, 30.0]
    got = [r["p"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").withColumn("p", stats.upper_tail(F.col("z"))).orderBy("i").collect()]
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-9, abs=1e-300)


def test_large_groups_take_the_normal_law(spark):
    d = [x / 10 for x in range(-30, 60) if x]
    r = stats.with_p(stats.signed_ranks(spark.createDataFrame([("g", x) for x in d], "g string, delta double"), ["g"], small=50), "greater").first()
    n, plus, minus = rank_sums(d)
    ties = sum(c ** 3 - c for c in (sum(abs(x) == m for x in d) for m in {abs(x) for x in d}))
    z = (plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert r["p"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_direction_and_dependence_by_sign_patterns(spark):
    """p-values of whole tables, cells of few values with ties, against all sign patterns."""
    metrics_ = spark.createDataFrame([("m", 1), ("k", -1)], "metric string, expected int")
    chain = ("msd_expert", "msd_lay", "gesund")
    pairs = [(a, b, f"{i}", f"{i}") for a, b in zip(chain, chain[1:]) for i in range(9)]
    rng = random.Random(8)
    values = {(m, s, str(i)): float(rng.randrange(0, 5)) for m in "mk" for s in chain for i in range(9)}
    vals = spark.createDataFrame([(*k, v) for k, v in values.items()], "metric string, source string, id string, value double")
    stat = significance.cells(metrics_, chain, spark.createDataFrame(pairs, "sa string, sb string, a string, b string"), vals)
    for r in significance.direction_table(stat).collect():
        d = [values[r["metric"], r["sb"], str(i)] - values[r["metric"], r["sa"], str(i)] for i in range(9)]
        assert r["p"] == pytest.approx(pattern_p(d, "greater" if r["metric"] == "m" else "less"), abs=1e-12)
    for r in significance.source_dependence(metrics_, chain, spark.createDataFrame(pairs, "sa string, sb string, a string, b string"), vals).collect():
        e = 1 if r["metric"] == "m" else -1
        d = [e * (values[r["metric"], r["sb"], str(i)] - values[r["metric"], r["sa"], str(i)]) for i in range(9)]
        assert r["p"] == pytest.approx(pattern_p(d, "greater"), abs=1e-12)


def walk(t):
    """Levels from the first root, along children that are not punctuation."""
    root = next((i for i, h, _ in t if i == h), None)
    level, deep, seen = [root] if root is not None else [], 0, {root}
    while level := [i for i, h, p in t if h in level and not p and i not in seen]:
        seen.update(level)
        deep += 1
    return float(deep)


def test_tree_depth_by_doubling(spark):
    rng = random.Random(2)
    nine = [(i, max(0, i - 1), False) for i in range(10)]  # a chain of ten tokens: depth 9
    trees = {0: nine, 1: [(0, 1, False), (1, 0, False)], 2: [(0, 0, True), (1, 0, True), (2, 1, False)], 3: [(0, 2, False), (1, 0, False), (2, 2, False), (3, 3, False), (4, 3, False)],
             4: [(0, 7, False), (1, 1, False), (2, -3, False)], 5: [(0, 0, False)]}
    for k in range(6, 60):
        n = rng.randrange(1, 40)
        trees[k] = [(i, rng.randrange(n) if rng.random() < 0.9 else i, rng.random() < 0.15) for i in range(n)]
    rows = [(k, 0, *x) for k, t in trees.items() for x in t]
    df = spark.createDataFrame(rows, "doc_id int, sent_id int, tok_i int, head_i int, is_punct boolean").repartition(5)
    got = {r["doc_id"]: r["dep_tree_depth"] for r in metrics.tree_depth(df).collect()}
    assert got == {k: walk(t) for k, t in trees.items()} and got[0] == 9.0
