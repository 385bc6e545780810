"""Measures of sentences kept as arrays: equal to those of the table of tokens, and without sorting one."""

import pytest
from textloom.operators import annotate, metrics
from textloom.plans import registry

DATA = "/root/testdata/sf0.001"
ODD = [(1, "One, two three. Four!\n\t\n ... ? (a) b.c"), (2, ""), (3, None), (4, "x"), (5, "Ärger — ½ 12 12. Straße, STRASSEİ - -")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in ODD], "doc_id long, text string"))


def rows(df):
    return sorted((r[0], *(x if x is None else round(x, 9) for x in r[1:])) for r in df.collect())


def test_depth_equals_that_of_tokens(docs):
    assert rows(metrics.tree_depth(annotate.sentence_words(docs))) == rows(metrics.tree_depth(annotate.tokens(docs)))


def test_no_token_is_sorted_or_gathered(spark):
    plan = registry.queries()["tree_depth"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
