"""Jobs that write, resume, retry or need p-values, against plain Python."""

import itertools
import json
import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import annotate, drivers, keyness, linkage, search, significance, stats, store
from textloom.sources import sinks


def plain_p(values, side):
    """Exact p of the signed-rank test by listing all signs; no ties, no zeros."""
    rank = {v: i + 1 for i, v in enumerate(sorted(map(abs, values)))}
    w = sum(rank[abs(v)] for v in values if v > 0)
    sums = [sum(c) for c in itertools.product(*((0, r) for r in rank.values()))]
    hi, lo = sum(x >= w for x in sums) / len(sums), sum(x <= w for x in sums) / len(sums)
    return {"greater": hi, "less": lo, "two-sided": min(1.0, 2 * min(hi, lo))}[side]


DELTAS = {("m", "a", "b"): [3.0, 1.5, -0.5, 4.0, 2.0, 6.0, 7.5], ("m", "b", "c"): [-3.0, -1.5, 0.5, -4.0, 2.25, -6.0], ("k", "a", "b"): [1.0, -2.0, 3.0, -4.0, 5.5, 7.0], ("k", "b", "c"): []}


def test_direction_table(spark):
    chain = ("a", "b", "c")
    pairs = [(x, y, f"{x}{y}{i}", f"{y}{x}{i}") for (m, x, y), v in DELTAS.items() for i in range(len(v)) if m == "m" or (x, y) == ("a", "b")]
    values = [(m, s, n, v) for (m, x, y), ds in DELTAS.items() for i, dv in enumerate(ds) for s, n, v in ((x, f"{x}{y}{i}", 10.0), (y, f"{y}{x}{i}", 10.0 + dv))]
    m = spark.createDataFrame([("m", 1), ("k", -1)], "metric string, expected int")
    p = spark.createDataFrame(sorted(set(pairs)), "sa string, sb string, a string, b string")
    v = spark.createDataFrame(values, "metric string, source string, id string, value double")
    got = {(r["metric"], r["sa"], r["sb"]): r for r in significance.direction_table(significance.cells(m, chain, p, v)).collect()}
    for (metric, a, b), ds in DELTAS.items():
        r = got[metric, a, b]
        assert r["n_values"] == len(ds)
        if ds:
            assert math.isclose(r["p"], plain_p(ds, "greater" if metric == "m" else "less")) and math.isclose(r["delta"], statistics.median(ds))
    assert got["k", "a", "b"]["verdict"] == "missing data" and got["m", "a", "b"]["verdict"].startswith("NEAR-MONO")
    wide = significance.direction_wide(significance.direction_table(significance.cells(m, chain, p, v))).collect()
    assert len(wide) == 2
    dep = {(r["metric"], r["sa"]): r["p"] for r in significance.source_dependence(m, chain, p, v).collect()}
    assert math.isclose(dep["k", "a"], plain_p([-x for x in DELTAS["k", "a", "b"]], "greater"))


def test_empty_chain_inputs(spark):
    m = spark.createDataFrame([("m", 1)], "metric string, expected int")
    p = spark.createDataFrame([], "sa string, sb string, a string, b string")
    v = spark.createDataFrame([], "metric string, source string, id string, value double")
    assert {r["verdict"] for r in significance.direction_table(significance.cells(m, ("a", "b", "c"), p, v)).collect()} == {"missing data"}


def test_family(spark):
    reg = spark.createDataFrame([("x", ["de"], True), ("y", ["en"], True), ("z", ["de", "en"], False)], "metric string, grids array<string>, shown boolean")
    assert {r["metric"] for r in significance.family_metrics(reg, "de").collect()} == {"x", "z"}
    assert {r["metric"] for r in significance.family_metrics(reg, "de", ["y", "x"]).collect()} == {"x", "y", "z"}
    assert [r["metric"] for r in significance.grid_covers(reg, "shown", "de").collect()] == ["y"]


def test_bleed_cells(spark):
    rows = [("m", st, o, o / 2) for st in (0, 1, 2) for o in (1.0, 2.0, 3.0, 4.5, 5.5, 6.5)]
    got = significance.bleed_cells(spark.createDataFrame(rows, "metric string, step int, d_orig double, d_simp double"), ["metric"], 3).first()
    assert got["stars"] == "***" and math.isclose(got["bleed_pct"], 50.0)


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("Heart pain", "Pain of the heart. Heart-pain!", '{"l":"en"}', [0.0, 1.0]), ("Asthma", "No air, heart fine", '{"l":"de"}', [1.0, 0.0])],
                                 "title string, text string, metadata string, embedding array<double>")
    st = store.from_rows(spark, str(tmp_path / "s"), rows)
    assert sorted(r["rowid"] for r in st.docs.collect()) == [1, 2]
    more = st.add(rows.limit(1).withColumn("title", F.lit("New heart")))
    assert [r["rowid"] for r in more.collect()] == [3]
    assert sum(i.term_counts().where("col = 'title_lower' and term = 'heart'").first()["n"] for i in st.indexes()) == 2
    q = spark.createDataFrame([(7, 1, "heart pain")], "query_id int, phrase_id int, phrase string")
    hit = st.search(q, 1).first()
    assert "<b>" in hit["text"] or "<b>" in hit["title"]
    text = next(r["text"] for r in st.search(q).collect() if r["rowid"] == 2)
    assert text == "Pain of the heart. <b>Heart-pain</b>!"
    q2 = spark.createDataFrame([(1, [0.1, 0.9])], "query_id int, q array<double>")
    assert st.nearest(q2, 1).first()["rowid"] in (2, 3)
    assert st.nearest(q2, 1, search.metadata_filter(F.col("metadata"), l="de")).first()["rowid"] == 1
    assert store.catalog("/x")["mesh"] == {"en": "/x/mesh_en", "de": "/x/mesh_de"}


def test_metric_table_resumes(spark, tmp_path):
    a = spark.createDataFrame([("msd", "amateur", "de", "1", "Das ist gut. Nicht schlecht."), ("msd", "amateur", "en", "2", "")], "source string, subtree string, language string, article_id string, text string")
    path = str(tmp_path / "m")
    one = {r["article_id"]: r for r in drivers.metric_table(a.limit(1), path).collect()}
    two = {r["article_id"]: r for r in drivers.metric_table(a.unionByName(a.limit(1)), path).collect()}
    assert set(one) == {"1"} and set(two) == {"1", "2"} and two["1"] == one["1"] and two["2"]["fkgl"] == -1.0
    assert one["1"]["negations_ratio"] == pytest.approx(1 / 5)


def test_jargon_detector(spark, tmp_path):
    (tmp_path / "default").mkdir()
    (tmp_path / "default" / "x-v-y.tsv").write_text("token\tor\tll\tref_rel_freq\nfoo\t50\t3\t0.0001\nbar\t0.5\t-2\t0.1\n")
    det = keyness.JargonDetector.read(spark, str(tmp_path), "x-v-y")
    words = spark.createDataFrame([("foo",), ("bar",), ("zzz",)], "word string")
    assert [(r["word"], r["score"], r["in_dict"]) for r in det.compare(words).collect()] == [("foo", 50.0, True), ("zzz", 1.0, False), ("bar", 0.5, True)]
    tok = spark.createDataFrame([(1, w) for w in "foo foo bar zzz".split()], "doc_id int, lemma string")
    got = [(r["token"], r["freq_in_text"], r["is_jargon"], r["place"]) for r in det.analyze(tok).orderBy("place").collect()]
    assert got == [("foo", 2, True, 1), ("zzz", 1, False, 2), ("bar", 1, False, 3)]
    assert [r["token"] for r in det.terms(tok, limit=1).collect()] == ["foo"]
    with pytest.raises(FileNotFoundError):
        keyness.JargonDetector.read(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        keyness.validated({"a": words})
    with pytest.raises(ValueError):
        keyness.formula("nope")


def test_percent_difference_without_reference(spark):
    df = spark.createDataFrame([(5.0, 0.0, 5.0, 10.0)], "a double, b double, c double, d double")
    assert df.select(keyness.percent_difference(*(F.col(x) for x in "abcd"))).first()[0] == math.inf


def flaky():
    """A judge that fails, then answers nonsense, then well; made by value, so workers need no test module."""
    calls = []

    def judge(a, b):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("busy")
        return ("nonsense" if len(calls) == 2 else "richtig"), {"prompt_tokens": 10, "cached_tokens": 5}

    return judge


def test_judging_retries_and_resumes(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "a"), (2, "b", "c")], "id int, title_a string, title_b string").coalesce(1)
    got = linkage.judged(pairs, flaky(), wait=0.001).orderBy("id").collect()
    assert [(r["pred"], r["attempts"]) for r in got] == [("richtig", 3), ("richtig", 1)]
    u = linkage.usage(linkage.judged(pairs, flaky(), wait=0.001)).first()
    assert (u["requests"], u["prompt_tokens"], u["cache_hit_rate"]) == (2, 20, 0.5)
    path = str(tmp_path / "j")
    say = lambda a, b: ("falsch", {})
    assert linkage.judge_run(pairs.where("id = 1"), None, say, path, ["id"]).count() == 1
    assert linkage.judge_run(pairs, None, say, path, ["id"]).count() == 2
    assert sinks.appended(spark, path, "slim").columns == ["id", "pred"] and sinks.appended(spark, path, "slim").count() == 2
    rest = linkage.judge_run(pairs, pairs, say, str(tmp_path / "k"), ["id"])
    assert rest.count() == 0


def test_overrides_by_source(spark):
    pairs = spark.createDataFrame([("x", "y", "msd", "nhs")], "title_a string, title_b string, source_a string, source_b string")
    index = spark.createDataFrame([("x", "1"), ("y", "2")], "title string, node string")
    over = spark.createDataFrame([("x", "gesund", "9"), ("y", "nhs", "8")], "title string, source string, node string")
    assert [(r["a"], r["b"]) for r in linkage.title_expand(pairs, index, over).collect()] == [("1", "8")]


def test_sinks(spark, tmp_path):
    nodes, edges = spark.range(3), spark.range(2)
    assert sinks.write_index(nodes, edges, str(tmp_path / "i")) == {"articles": 3, "pairs": 2}
    assert json.loads(spark.read.text(str(tmp_path / "i/summary")).first()[0]) == {"articles": 3, "pairs": 2}
    sinks.write_sheets({"a": nodes, "b": edges}, str(tmp_path / "s"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "s/a")).count() == 3
    rows = spark.createDataFrame([("m", "s", "1 ± 2", "*", False, 40.0, "**", 1, "PASS")], "metric string, source string, cell string, marker string, leftover boolean, bleed_pct double, stars string, expected int, verdict string")
    assert "40\\%**" in sinks.bleed_table(rows) and "PASS" in sinks.direction_report(rows) and "1 ± 2" in sinks.metrics_table(rows) and "1 ± 2" not in sinks.metrics_table(rows, True)


def test_simplify_job(spark, tmp_path):
    items = spark.createDataFrame([("de", "1", "4_tier", 1, "Kurz."), ("en", "2", "4_tier", 1, "Short."), ("en", "3", "3_tier", 2, "Short.")], "language string, article_id string, bucket string, turn int, text string")
    path = str(tmp_path / "o")
    assert drivers.simplify_job(items, path, dry=True).count() == 2
    assert drivers.simplify_job(items, path, limit=1).count() == 1
    assert drivers.simplify_job(items, path).count() == 2


def test_small_ones(spark):
    assert drivers.load_models("de", "cpu")["causal"] == "dbmdz/german-gpt2"
    assert drivers.doctor(spark, ["/root/testdata", "/nowhere"], ("json", "no_such_module")) == {"/root/testdata": True, "/nowhere": False, "json": True, "no_such_module": False}
    df = spark.createDataFrame([(1, "I don't know, it's e.g. 3.5! :-) http://x.y/z a@b.co")], "doc_id int, text string")
    assert [r["token"] for r in annotate.social_tokens(df).orderBy("i").collect()] == ["I", "don't", "know", ",", "it's", "e.g.", "3.5", "!", ":-)", "http://x.y/z", "a@b.co"]
    assert [r["token"] for r in annotate.treebank_tokens(df).orderBy("i").collect()][:7] == ["I", "do", "n't", "know", ",", "it", "'s"]
    df = spark.createDataFrame([(1, "Äb c")], "doc_id int, text string")
    assert [tuple(r) for r in annotate.search_tokens(df, lemma=lambda w: F.when(w == "c", "--").otherwise("x")).orderBy("i").collect()] == [(1, 0, "x", 0, 3), (1, 1, "c", 4, 5)]


def test_offsets_of_terms_need_no_sort(spark):
    df = spark.createDataFrame([(1, "Äb, c"), (2, None), (3, " ..é\n"), (4, ""), (1, "x  y")], "doc_id int, text string")
    got = annotate.search_tokens(df)
    want = [(d, i, m.group().lower(), len(t[:m.start()].encode()), len(t[:m.end()].encode())) for d, t in ((1, "Äb, c"), (3, " ..é\n"), (1, "x  y")) for i, m in enumerate(re.finditer(r"\w+|[^ \n\w]", t))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_markdown(spark):
    md = "# Head\n\ntext *it* **b** [a](u) ![i](v) $x+1$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- one\n  - two\n\n> said\n\n```\ncode\n```\nend[^1]\n\n[^1]: note"
    assert T.markdown_text(md).split("\n\n") == ["Head", "text it b a", "one", "two", "said", "code", "end", "note"]


def test_wrong_markers(spark):
    df = spark.createDataFrame([(1.0, 0.01, 1), (-1.0, 0.9999, 1), (-1.0, 0.02, 0), (0.0, 0.97, 1)], "d double, p double, e int")
    got = [r[0] for r in df.select(stats.wrong_marker(F.col("d"), F.col("p"), F.col("e"))).collect()]
    assert got == ["", "***", "", "*"]
