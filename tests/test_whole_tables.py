"""Queries that once left rows out, against all rows of the smallest tables."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import index, search
from textloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("how", ["outer", "inner"])
def test_merge_has_every_token(spark, how):
    st, rf = registry._freqs(spark, DATA)
    every = {r["token"] for r in st.select("token").union(rf.select("token")).distinct().collect()}
    got = [r["token"] for r in registry.queries()[f"keyness_merge_{how}"](spark, DATA).collect()]
    assert len(got) == len(every) and set(got) == every


def test_lookup_equals_phrase_search(spark):
    rows = registry._titles(spark, DATA).withColumnRenamed("doc_id", "rowid")
    q = registry._title_queries(rows.where("rowid % 7 = 0"))
    one = q.selectExpr("query_id", "posexplode(phrases) as (phrase_id, phrase)").withColumn("col", F.lit("title"))
    want = index.build(rows).bm25(one, 5)
    key = lambda df: sorted((r["query_id"], r["rn"], r["rowid"], round(r["rank"], 9)) for r in df.collect())
    got = key(search.lookup_hits(rows, q))
    assert got == key(want) and len(got) > 25


def test_reverse_search_looks_titles_up(spark):
    near, rows = registry._near(spark, DATA), registry._titles(spark, DATA).withColumnRenamed("doc_id", "rowid")
    one = registry._title_queries(rows).selectExpr("query_id", "posexplode(phrases) as (phrase_id, phrase)").withColumn("col", F.lit("title"))
    back = {(r["query_id"], r["rowid"]) for r in index.build(rows).bm25(one, 5).collect()}
    want = {}
    for r in sorted(near.collect(), key=lambda r: (r["query_id"], r["distance"], r["rowid"])):
        if (r["rowid"], r["query_id"]) in back:
            want.setdefault(r["query_id"], r["rowid"])
    got = {r["query_id"]: r["rowid"] for r in registry.queries()["reverse_search"](spark, DATA).collect()}
    assert got == want and any(x % 2 == 0 for x in got.values())


def test_unresolved_titles_use_every_node(spark):
    got = {r["side"]: r["n"] for r in registry.queries()["unresolved_titles"](spark, DATA).collect()}
    assert got == {"a": 0, "b": 0}  # pairs and nodes are the same documents


def test_title_lookup_takes_titles(spark):
    rows = registry._titles(spark, DATA).withColumnRenamed("doc_id", "rowid")
    one = registry._title_queries(rows.where("rowid % 20 = 0")).selectExpr("query_id", "posexplode(phrases) as (phrase_id, phrase)").withColumn("col", F.lit("title"))
    meta = {r["rowid"]: r for r in rows.select("rowid", "source", "language").collect()}
    want = {}
    for r in index.build(rows).bm25(one, 5).collect():
        want.setdefault(r["query_id"], []).append(meta[r["rowid"]])
    want = {q: (",".join(sorted({r["source"] for r in rs})), ",".join(sorted({r["language"] for r in rs}))) for q, rs in want.items()}
    got = {r["query_id"]: (r["sources"], r["languages"]) for r in registry.queries()["title_lookup"](spark, DATA).collect()}
    assert got == want and len(got) > 4
