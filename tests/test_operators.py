"""Operators on small hand-made tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import index, keyness, linkage, metrics, stats
from textloom.sources import corpus, sinks
from textloom.streaming import incremental


def test_exact_signed_rank(spark):
    df = spark.createDataFrame([("m", float(x)) for x in (1, 2, 3, -4, 5, 0)], "metric string, delta double")
    r = stats.with_p(stats.signed_ranks(df, ["metric"]), "greater").first()
    assert (r["n"], r["w_plus"], r["w_minus"], r["n_all"]) == (5, 11.0, 4.0, 6)
    assert r["p"] == pytest.approx(7 / 32)


def test_all_zero_deltas(spark):
    r = stats.with_p(stats.signed_ranks(spark.createDataFrame([("m", 0.0)] * 3, "metric string, delta double"), ["metric"])).first()
    assert r["p"] is None and r["median_delta"] == 0.0


def test_holm_stops(spark):
    df = spark.createDataFrame([("f", "a", 0.001), ("f", "b", 0.03), ("f", "c", 0.02), ("f", "d", None)], "metric string, step string, p double")
    got = {r["step"]: r["reject"] for r in stats.rejected(df, ["metric"]).collect()}
    assert got == {"a": True, "c": True, "b": True, "d": False}


def test_tree_depth(spark):
    rows = [(1, 0, 0, 0, False), (1, 0, 1, 0, False), (1, 0, 2, 1, True), (1, 0, 3, 2, False), (1, 1, 0, 0, False)]
    tok = spark.createDataFrame(rows, "doc_id int, sent_id int, tok_i int, head_i int, is_punct boolean")
    assert metrics.tree_depth(tok).first()["dep_tree_depth"] == 0.5


def test_markdown():
    md = "# Title\n\nA [link](http://x) and ![pic](y) with $x^2$ math.\n\n| a | b |\n|---|---|\n\n- item[^1]\n\n[^1]: a note\n"
    assert T.markdown_text(md) == "Title\n\nA link and with math.\n\nitem\n\na note"


def test_negative_smoothing(spark):
    f = spark.createDataFrame([("a", 1)], "token string, freq long")
    with pytest.raises(ValueError):
        keyness.contingency(f, f, -1)


def test_merge_names(spark):
    f, g = spark.createDataFrame([("a", 3), ("b", 1)], "token string, freq long"), spark.createDataFrame([("a", 1), ("c", 2)], "token string, freq long")
    out = keyness.merged({"x-v-y": keyness.compare(f, g, ("ll",))}, "outer", 0.0)
    assert {"abs-freq_x", "abs-freq_y", "x-v-y_ll"} <= set(out.columns) and out.count() == 3


def test_two_hops(spark):
    idx = spark.createDataFrame([("MeSH", "1", "nhs", "a"), ("DOID", "9", "nhs", "a"), ("DOID", "9", "apoum", "b"), ("ICD-10", "7", "apoum", "b"), ("ICD-10", "7", "nhs", "c")], "vocab string, value string, source string, instance string")
    got = {r["instance"] for r in linkage.expand_two_hops(idx).where("vocab = 'MeSH'").collect()}
    assert got == {"a", "b"}  # two hops, not the closure


def test_phrases(spark):
    t = spark.createDataFrame([(1, "heart attack", "signs of heart attack"), (2, "attack heart", "none")], "rowid long, title string, text string")
    q = spark.createDataFrame([(1, 1, "heart attack", "title")], "query_id int, phrase_id int, phrase string, col string")
    found = index.build(t)
    assert [(r["rowid"], r["rn"]) for r in found.bm25(q).collect()] == [(1, 1)]
    assert sorted(r["rowid"] for r in found.bm25(q.withColumn("col", F.lit(None).cast("string"))).collect()) == [1]


def test_sources_and_sinks(spark, tmp_path):
    rec = [{"source": "nhs", "language": "en", "instance_id": "1", "article_id": "1", "title": "T", "paragraphs": [{"title": "p", "text": "x"}], "plain_text": "x"}]
    (tmp_path / "nhs_amateur_en.json").write_text(json.dumps(rec))
    df = corpus.records(spark, str(tmp_path))
    assert df.select("source", "subtree", "language").first() == ("nhs", "amateur", "en") and len(corpus.missing_files(spark, str(tmp_path))) == 9
    assert df.select(T.to_markdown(F.col("title"), F.col("paragraphs"))).first()[0] == "# T\n\nx"
    (tmp_path / "f.json").write_text('{"word_freqs_lemma": {"NA": "3", "b": "1"}}')
    assert {tuple(r) for r in corpus.frequency_list(spark, str(tmp_path / "f.json")).collect()} == {("NA", 3), ("b", 1)}
    sinks.append_new(df.select("article_id"), str(tmp_path / "out"), ["article_id"])
    sinks.append_new(df.select("article_id"), str(tmp_path / "out"), ["article_id"])
    assert sinks.appended(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        sinks.append_new(df.select("article_id", "title"), str(tmp_path / "out"), ["article_id"])
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row></sheetData></worksheet>')
    assert {tuple(r) for r in corpus.spreadsheet(spark, str(tmp_path / "b.xlsx")).collect()} == {(1, "A", "hello"), (1, "B", "5")}


def test_streaming_append(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("id long, text string").parquet(str(src))
    for _ in range(2):
        q = incremental.append_measures(stream, lambda b: b.select("id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"), "id")
        q.awaitTermination()
    assert sinks.appended(spark, str(tmp_path / "out")).count() == 2


def test_entry_without_optional_part():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
