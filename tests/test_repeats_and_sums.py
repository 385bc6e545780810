"""Repeated phrases, whole lookups and sums beyond 64 bits."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import index, search, stats
from textloom.plans import reports

DATA = "/root/testdata/sf0.001"


def test_every_title_is_looked_up(spark):
    titled = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id is not null and regexp_like(split_part(text, '\n', 1), '[a-zA-Z]')").count()
    got = reports.queries()["lookup_links"](spark, DATA).select("id").distinct().count()
    assert got > 0.9 * titled > 100


def test_phrases_of_the_same_words_count_once(spark):
    rows = spark.createDataFrame([(1, "aa cc", "x"), (2, "bb cc dd", "x"), *((i, "zz", "x") for i in range(3, 30))], "rowid long, title string, text string")
    q = spark.createDataFrame([(1, ["aa", "aa!", "bb"]), (2, ["aa", "bb"])], "query_id long, phrases array<string>")
    one = q.select("query_id", F.posexplode("phrases").alias("phrase_id", "phrase")).withColumn("col", F.lit("title"))
    for found in (search.lookup_hits(rows, q), index.build(rows).bm25(one, 5)):
        by = {n: [(r["rn"], r["rowid"], round(r["rank"], 9)) for r in sorted(found.collect(), key=lambda r: r["rn"]) if r["query_id"] == n] for n in (1, 2)}
        assert by[1] == by[2] and len(by[1]) == 2


def test_cubes_of_counts_pass_64_bits(spark):
    n = 2_200_000
    d = spark.range(n + 1000).select(F.lit("g").alias("k"), F.when(F.col("id") < n, 1.0).otherwise(-2.0).alias("delta"))
    got = stats.with_p(stats.signed_ranks(d, ["k"])).first()
    assert int(got["ties"]) == n ** 3 - n + 1000 ** 3 - 1000 > 2 ** 63
    total = n + 1000
    var = (total * (total + 1) * (2 * total + 1) * 2 - (n ** 3 - n + 1000 ** 3 - 1000)) / 48
    assert abs(got["z"] / ((n * (n + 1) / 2 - total * (total + 1) / 4) / var ** 0.5) - 1) < 1e-12 and got["p"] == 0


def test_one_expression_is_answered_without_an_index(spark):
    from textloom.plans import learned
    rows = [(1, "heart", "pain in the heart"), (2, "Heart", "no  Pain"), (3, "lung", "pain, in the lung"), (4, None, "the heart"), (5, "", None), (6, "--", "...")]
    docs = spark.createDataFrame(rows, "rowid long, title string, text string")
    found = index.build(docs)
    p = lambda text, col=None: ("phrase", col, text)
    for x in (p("heart"), p("heart", "title"), ("and", p("heart"), ("not", p("in the heart"))), ("not", p("nothing")), p("(("), p("art"), ("or", p("PAIN in", "text"), ("and", p("no-pain"), ("not", p("lung"))))):
        ids = lambda df: sorted(r["rowid"] for r in df.collect())
        assert ids(search.admitted(docs, x)) == ids(found.matching(x)), x
    for bad in (("xor", p("a"), p("b")), ("not", p("a"), p("b")), ("and",), ("phrase", "body", "a")):
        with pytest.raises(ValueError):
            search.admitted(docs, bad)
    plan = learned.queries()["boolean_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "postings" not in plan and plan.count("regexp_extract_all") == 2


def test_queries_of_the_same_phrases_are_ranked_once(spark):
    rows = spark.createDataFrame([(i, "aa bb" if i % 2 else "aa", "x") for i in range(40)], "rowid long, title string, text string")
    q = spark.createDataFrame([(n, i, p) for n in range(60) for i, p in enumerate(["aa", "bb"][:1 + n % 2])], "query_id long, phrase_id int, phrase string").withColumn("col", F.lit("title"))
    made = index.build(rows)
    every = {(r["query_id"], r["rn"]): (r["rowid"], round(r["rank"], 9)) for r in made.bm25(q).collect()}
    cut = {(r["query_id"], r["rn"]): (r["rowid"], round(r["rank"], 9)) for r in made.bm25(q, 3).collect()}
    assert cut == {x: y for x, y in every.items() if x[1] <= 3} and len(every) == 60 * 40
    some = {(r["query_id"], r["rn"]): (r["rowid"], round(r["rank"], 9)) for r in made.bm25(q, 3, rows.where("rowid >= 30")).collect()}
    assert len(some) == 180 and all(y[0] >= 30 and y in {every[x[0], n] for n in range(1, 41)} for x, y in some.items())
    # Ranking rows by query would make 60 times 40 of them.
    plan = made.bm25(q, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(query_id" not in plan and "windowspecdefinition(set" in plan
