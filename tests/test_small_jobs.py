"""Jobs that no query runs: searches by names, titles of metrics, jargon of rewritten texts, embeddings, command options."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import drivers, significance, store
from textloom.sources import corpus


def test_every_name_is_its_own_search(spark):
    rows = spark.createDataFrame([("a", "Heart attack", ["Myocardial infarction", "Heart attack", " "]), ("b", None, None), ("c", "Flu", [])], "id string, name string, alternative array<string>")
    got = sorted((r["query_id"], tuple(r["phrases"])) for r in store.topic_queries(rows, "id", "name", "alternative").collect())
    assert got == [("a", ("heart attack",)), ("a", ("myocardial infarction",)), ("c", ("flu",))]


def test_titles_of_metrics(spark):
    reg = spark.createDataFrame([("x", "Länge", "Length")], "metric string, title_de string, title_en string")
    df = spark.createDataFrame([("x",), ("y",)], "metric string")
    assert {r["metric"]: r["title"] for r in significance.titled(df, reg, "de").collect()} == {"x": "Länge", "y": None}


def test_jargon_of_each_language(spark):
    table = lambda word: spark.createDataFrame([(word, 100.0, 5.0, 0.00001)], "token string, or double, ll double, ref_rel_freq double")
    texts = spark.createDataFrame([("1", "de", "Angina ist Angina"), ("2", "en", "angina is pain"), ("3", "fr", "angina")], "article_id string, language string, text string")
    texts = texts.withColumn("text", F.lower("text"))
    got = {r["article_id"]: r for r in drivers.jargon_run(texts, {"de": table("angina"), "en": table("pain")}).collect()}
    assert set(got) == {"1", "2"}
    share = {k: next(v for n, v in r.asDict().items() if "per_100" in n) for k, r in got.items()}
    assert share["1"] == pytest.approx(200 / 3, abs=1e-4) and share["2"] == pytest.approx(100 / 3, abs=1e-4)


def test_the_last_embedding_of_a_key_counts(spark, tmp_path):
    lines = [{"key": "a", "embedding": [0.0, float(i)]} for i in range(50)] + [{"key": "b", "embedding": [1.0]}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = [tuple(r) for r in corpus.embeddings(spark, str(tmp_path / "e.jsonl"), 2).collect()]
    assert got == [("a", [0.0, 49.0])]


def test_unknown_labels_and_judges_are_refused(spark):
    none = spark.createDataFrame([], "a string, b string, source_a string, source_b string, a_view string, b_view string, label string, judge string")
    with pytest.raises(ValueError, match="label"):
        significance.aligned_significance(none, none, none, "de", ["perhaps"], ["human"])
    with pytest.raises(ValueError, match="judge"):
        significance.aligned_significance(none, none, none, "de", ["richtig"], ["crowd"])


def test_steps_between_sources_ignore_views_and_steps_within_one_do_not(spark):
    rows = [("1", "1", "msd", "msd", "de_amateur", "de_professional"), ("2", "2", "msd", "msd", "en_professional", "en_amateur"), ("3", "4", "msd", "msd", "de_professional", "de_amateur"),
            ("5", "6", "gesund", "msd", "x", "en_professional"), ("5", "6", "gesund", "msd", "y", None), ("7", "8", "gesund", "nhs", None, None)]
    edges = spark.createDataFrame(rows, "a string, b string, source_a string, source_b string, a_view string, b_view string")
    ask = lambda lang: sorted(tuple(r) for r in significance.step_pairs(edges, significance.CHAINS[lang], lang).collect())
    assert ask("de") == [("msd_expert", "msd_lay", "1", "1"), ("msd_lay", "gesund", "6", "5")]
    assert ask("en") == [("gesund", "nhs", "7", "8"), ("msd_expert", "msd_lay", "2", "2"), ("msd_lay", "gesund", "6", "5")]
