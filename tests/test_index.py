"""The positional index, numbering and committed batches."""

import math
import re
import threading

import pytest
from pyspark.sql import functions as F

from textloom.operators import index, linkage, search, store
from textloom.plans import registry
from textloom.sources import sinks

DATA, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\W_]+")


def rows_of(spark, n=700, seed=7):
    """Documents of few words, some of which nearly all hold."""
    import random
    rng = random.Random(seed)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(60)]
    one = lambda m: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(m))
    rows = [(i, one(rng.randrange(0, 4)), one(rng.randrange(0, 40))) for i in range(1, n)] + [(n, None, "The of THE of the"), (n + 1, "", None)]
    return rows, spark.createDataFrame(rows, "rowid long, title string, text string")


def plain_bm25(rows, queries, k=None):
    toks = {i: {"title": WORD.findall((t or "").lower()), "text": WORD.findall((x or "").lower())} for i, t, x in rows}
    dl = {i: sum(map(len, c.values())) for i, c in toks.items()}
    dl = {i: n for i, n in dl.items() if n}
    avg, total = sum(dl.values()) / len(dl), len(dl)
    out = []
    for q, phrases in queries.items():
        score = {}
        for phrase, col in phrases:
            p = WORD.findall(phrase.lower())
            tf = {i: sum(w[a:a + len(p)] == p for c, w in toks[i].items() if col in (None, c) for a in range(len(w) - len(p) + 1)) for i in dl}
            tf = {i: n for i, n in tf.items() if n and p}
            w = max(math.log((total - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
            for i, n in tf.items():
                score[i] = score.get(i, 0) + w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[i] / avg))
        best = sorted(score.items(), key=lambda s: (round(-s[1], 9), s[0]))
        out += [(q, i, r + 1) for r, (i, _) in enumerate(best[:k])]
    return sorted(out)


ASKED = {1: [("the of", None), ("w1", None)], 2: [("the", "title")], 3: [("the the the", "text"), ("w3 of", "text")], 4: [("nothing here", None)], 5: [("of the of the", None)], 6: [("", None)]}


@pytest.mark.parametrize("parts", [1, 3])
def test_phrases_rank_as_in_plain_python(spark, tmp_path, parts):
    rows, df = rows_of(spark)
    made = index.PositionalIndex(spark, str(tmp_path / "i"), ("title", "text"), 4)
    for a in range(parts):  # the second and third append begin within a block
        made.append(df.where(F.floor((F.col("rowid") - 1) / (702 / parts)) == a))
    q = spark.createDataFrame([(q, i, p, c) for q, ps in ASKED.items() for i, (p, c) in enumerate(ps)], "query_id int, phrase_id int, phrase string, col string")
    again = index.PositionalIndex(spark, str(tmp_path / "i"), ("title", "text"), 4)
    for use in (made, again):
        assert sorted((r["query_id"], r["rowid"], r["rn"]) for r in use.bm25(q, 15).collect()) == plain_bm25(rows, ASKED, 15)


def test_best_prunes_blocks_and_ranks_exactly(spark, tmp_path):
    rows, df = rows_of(spark, 20_000, 11)
    made = index.build(df, ("title", "text"), str(tmp_path / "i"))
    asked = {1: ["w1", "the"], 2: ["w5", "w6", "absent"], 3: ["the"], 4: ["absent"], 5: ["w9"], 6: ["w10"], 7: ["w11"]}
    q = spark.createDataFrame([(q, t, "text") for q, ts in asked.items() for t in ts], "query_id int, term string, col string")
    seen = {}
    got = sorted((r["query_id"], r["rowid"], r["rn"]) for r in made.best(q, 5, seen).collect())
    assert got == plain_bm25(rows, {q: [(t, "text") for t in ts] for q, ts in asked.items()}, 5)
    print(f"blocks scored: {seen['scored']} of {seen['blocks']}")
    assert seen["scored"] < 0.5 * seen["blocks"]


def test_postings_are_joined_where_they_lie(spark, tmp_path):
    """No exchange stands between a scan of the postings and its join."""
    _, df = rows_of(spark)
    made = index.build(df, ("title", "text"), str(tmp_path / "i"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        phrases = spark.createDataFrame([(["the", "of", "w1"], None)], "phrase array<string>, want string")
        plan = made.phrase_hits(phrases)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "_postings" in line]
    assert len(scans) >= 2
    for i in scans:
        d, above = depth(plan[i]), []
        for line in reversed(plan[:i]):
            if depth(line) < d:
                d = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above), "\n".join(above)


def test_index_equals_lookup_without_index(spark):
    rows = registry._rows(spark, DATA)
    q = registry._title_queries(rows.where("rowid % 7 = 0"))
    key = lambda df: sorted((r["query_id"], r["rn"], r["rowid"], round(r["rank"], 9)) for r in df.collect())
    one = q.selectExpr("query_id", "posexplode(phrases) as (phrase_id, phrase)").withColumn("col", F.lit("text"))
    assert key(index.build(rows).bm25(one, 5)) == key(search.lookup_hits(rows, q, 5, "text"))


# ---- numbering ------------------------------------------------------------------------------------

def test_numbers_of_many_rows_are_distinct_and_without_gaps(spark):
    rows = registry._titles(spark, LARGE).withColumns({"metadata": F.lit("{}"), "embedding": F.array(F.lit(0.0))})
    got = [(r["rowid"], r["title"], r["text"]) for r in store.prepared(rows, ("title", "text"), 100).select("rowid", "title", "text").collect()]
    assert sorted(g[0] for g in got) == list(range(101, 101 + len(got))) and len(got) == rows.count()
    got.sort()
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_two_appends_number_on(spark, tmp_path):
    rows = registry._titles(spark, LARGE).select("title", "text", F.lit("{}").alias("metadata"), F.array(F.lit(0.0)).alias("embedding"))
    part = rows.where(F.length("text") < 500)
    st = store.SearchStore(spark, str(tmp_path / "s"))
    n = st.add(part).count()
    new = [r["rowid"] for r in st.add(part).select("rowid").collect()]
    assert sorted(new) == list(range(n + 1, 2 * n + 1))
    assert st.docs.select("rowid").distinct().count() == 2 * n
    q = spark.createDataFrame([(1, 0, part.select("title").first()[0])], "query_id int, phrase_id int, phrase string")
    hits = [r["rowid"] for r in st.search(q).collect()]
    assert len(hits) % 2 == 0 and any(h <= n for h in hits) and any(h > n for h in hits)


# ---- committed batches ----------------------------------------------------------------------------

def test_a_failure_between_two_tables_is_not_seen(spark, tmp_path):
    path, ledger = str(tmp_path / "b"), sinks.Ledger(spark, str(tmp_path / "b"))
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    broken = a.withColumn("w", F.raise_error(F.lit("down")).cast("string"))
    with pytest.raises(Exception, match="down"):
        sinks.append_all({"one": a, "two": broken}, path, ["id"])
    assert ledger.batches() == []
    two = a.withColumn("w", F.lit("ok"))
    for _ in range(2):
        sinks.append_all({"one": a, "two": two}, path, ["id"])
        assert ledger.read("one").count() == ledger.read("two").count() == 2
    sinks.append_all({"one": a.selectExpr("id + 1 as id", "v"), "two": two.selectExpr("id + 1 as id", "v", "w")}, path, ["id"])
    assert sorted(r["id"] for r in ledger.read("two").collect()) == [1, 2, 3]


def test_two_writers_never_repeat_keys(spark, tmp_path):
    path, errors = str(tmp_path / "b"), []

    def work(k):
        try:
            for i in range(4):
                sinks.append_new(spark.range(i * 5, i * 5 + 10).withColumn("who", F.lit(k)), path, ["id"])
        except Exception as e:  # told to the main thread
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = [r["id"] for r in sinks.appended(spark, path).collect()]
    assert sorted(got) == list(range(25))


def test_judging_writes_both_tables_or_none(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, title_a string, title_b string")

    def fails(a, b):
        raise RuntimeError("no answer")

    with pytest.raises(Exception):
        linkage.judge_run(pairs, None, fails, str(tmp_path / "j"), ["id"])
    assert sinks.Ledger(spark, str(tmp_path / "j")).batches() == []
    assert linkage.judge_run(pairs, None, lambda a, b: ("falsch", {}), str(tmp_path / "j"), ["id"]).count() == 2
    assert sinks.appended(spark, str(tmp_path / "j"), "slim").count() == 2


# ---- nearest neighbours ---------------------------------------------------------------------------

def vectors_of(spark, n, spread, groups=8, width=12):
    import numpy as np
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(groups, width)) * 5
    x = centre[np.arange(n) % groups] + rng.normal(size=(n, width)) * spread
    x[:40] = x[0]  # one vector many times: ties go by number
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]
    return x, spark.createDataFrame(rows, "rowid long, embedding array<double>, part int").repartition(3)


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
@pytest.mark.parametrize("on", [[], ["part"]])
def test_pruned_neighbours_are_exact(spark, metric, on):
    import numpy as np
    x, df = vectors_of(spark, 900, 0.3)
    odd = spark.createDataFrame([(5000, None, 0), (5001, [0.0] * 12, 1)], df.schema)
    q = df.where("rowid % 50 = 0").selectExpr("rowid as query_id", "embedding as q", "part")
    seen = {}
    got = {}
    for r in search.nearest(q.select("query_id", "q", *on), df.unionByName(odd).select("rowid", "embedding", *on), 5, metric, on, seen=seen).collect():
        got.setdefault(r["query_id"], []).append((r["rn"], r["rowid"], round(r["distance"], 6)))
    for i in range(0, 900, 50):
        d = {"l2": lambda a, b: np.sqrt(((a - b) ** 2).sum(1)), "l1": lambda a, b: np.abs(a - b).sum(1),
             "cosine": lambda a, b: 1 - (a @ b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b))}[metric](x, x[i])
        ids = [j for j in range(900) if not on or j % 3 == i % 3]
        want = [(round(float(d[j]), 6), j) for j in ids] + ([(round(float({"l2": np.linalg.norm(x[i]), "l1": np.abs(x[i]).sum()}.get(metric, 9)), 6), 5001)] if metric != "cosine" and (not on or i % 3 == 1) else [])
        assert [e for _, _, e in sorted(got[i])] == [e for e, _ in sorted(want)[:5]]
        if metric != "cosine":  # ties in the last digits may order otherwise under cosine
            assert [j for _, j, _ in sorted(got[i])] == [j for _, j in sorted(want)[:5]]
    print(f"{metric} {on}: scored {seen['scored']} of {seen['pairs']} pairs")


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
def test_under_a_tenth_of_the_pairs_is_scored(spark, metric):
    _, df = vectors_of(spark, 4000, 0.02, groups=40)
    q = df.where("rowid % 100 = 0").selectExpr("rowid as query_id", "embedding as q")
    seen = {}
    assert search.nearest(q, df.select("rowid", "embedding"), 5, metric, seen=seen).count() == 200
    print(f"{metric}: scored {seen['scored'] / seen['pairs']:.3f} of all pairs")
    assert seen["scored"] < 0.1 * seen["pairs"]


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
def test_block_distances_have_the_bits_of_the_expression(spark, metric):
    import numpy as np
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(7, 33)), rng.normal(size=(5, 33)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, j, a[i].tolist(), b[j].tolist()) for i in range(7) for j in range(5)], "i int, j int, a array<double>, b array<double>")
    got = search.pair_distances(a, b, metric)
    assert all(r["d"] == got[r["i"], r["j"]] for r in df.select("i", "j", search.distance(df["a"], df["b"], metric).alias("d")).collect())


def test_vectors_with_nulls_or_of_other_widths_are_no_neighbours(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, None]), (3, [1.0]), (4, [3.0, 1.0]), (5, None)], "rowid long, embedding array<double>")
    q = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [2.0])], "query_id string, q array<double>")
    got = [(r["query_id"], r["rowid"], r["distance"]) for r in search.nearest(q, rows, 5).orderBy("query_id", "rn").collect()]
    assert got == [("x", 1, 0.0), ("x", 4, 3.0), ("y", 3, 1.0)]


def test_no_pair_of_vectors_is_scored_by_an_interpreted_expression(spark, capsys):
    df = spark.range(50).selectExpr("id as rowid", "array(double(id), 1d) as embedding")
    search.nearest(df.selectExpr("rowid as query_id", "embedding as q"), df, 3).explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_scores_have_the_bits_of_the_formula_and_ranks_are_rounded_in_binary(spark):
    import random
    r = random.Random(3)
    rows = [(i, r.uniform(1e-6, 12), r.randint(1, 9), r.randint(1, 90_000), r.uniform(400, 900)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, w double, tf long, dl long, a double")
    got = {x["i"]: x["s"] for x in df.select("i", index.score(df["w"], df["tf"], df["dl"], df["a"]).alias("s")).collect()}
    assert all(got[i] == w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) for i, w, tf, dl, a in rows)
    edge = [round(-k - 0.5 * 1e-9 - j * 1e-9, 10) for k in range(20) for j in range(20)]
    binary = lambda x: -float(int(-x * 1e9 + 0.5))
    edge = [x for x in edge if abs(abs(x * 1e9) % 1 - 0.5) < 1e-3]
    placed = [x["p"] for x in spark.createDataFrame([(x,) for x in edge], "rank double").coalesce(1).select(index.place("rank").alias("p")).collect()]
    assert placed == [binary(x) for x in edge] and len(edge) > 100


def test_no_token_is_shuffled_when_postings_are_made(spark, tmp_path, monkeypatch):
    """Texts are dealt out by block; what is dealt out by term are postings, one row for all of a block's documents."""
    _, df = rows_of(spark)
    plans, write = {}, index.PositionalIndex._write

    def kept(self, name, out):
        plans[name] = out._jdf.queryExecution().optimizedPlan().toString()
        write(self, name, out)

    monkeypatch.setattr(index.PositionalIndex, "_write", kept)
    made = index.build(df, ("title", "text"), str(tmp_path / "i"))
    assert "MapInArrow" in plans["postings"] and "Generate" not in plans["postings"] and "rows" not in plans["skips"].split("\n")[0]
    got = {(r["col"], r["term"], x["rowid"]): (x["dl"], x["pos"]) for r in made.table("postings").collect() for x in r["rows"]}
    want = {}
    for r in df.collect():
        w = {c: WORD.findall((r[c] or "").lower()) for c in ("title", "text")}
        for c in w:
            for i, t in enumerate(w[c]):
                want.setdefault((c, t, r["rowid"]), (sum(map(len, w.values())), []))[1].append(i)
    assert got == want


def test_hits_are_ranked_before_texts_join_them(spark, tmp_path):
    _, df = rows_of(spark)
    asked = spark.createDataFrame([(1, 0, "the of"), (2, 0, "w1")], "query_id int, phrase_id int, phrase string")
    got = store.highlighted(df, index.build(df, ("title",), str(tmp_path / "i")), asked, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    at = next(i for i, line in enumerate(plan) if "Window [row_number()" in line)
    below = [line for line in plan[at + 1:] if depth(line) > depth(plan[at])]
    assert below and not any("text#" in line and "Relation" not in line and "LogicalRDD" not in line for line in below), "\n".join(plan)
    assert sorted((r["query_id"], r["rn"]) for r in got.collect()) == [(q, n) for q in (1, 2) for n in (1, 2, 3)]
