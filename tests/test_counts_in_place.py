"""Counts and places found within a text's own arrays, and pairs of nodes made from blocks."""

from pyspark.sql import functions as F

from textloom.operators import annotate, keyness, language_model, linkage, metrics
from textloom.plans import registry


def test_words_of_a_text_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "doc_id long, w array<string>")
    got = annotate.word_counts(df, F.col("w"), "doc_id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1), (1, "b", 2), (4, "x", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_that_share_a_key_are_counted_together(spark, tmp_path):
    spark.createDataFrame([(1, "b a b"), (1, "B c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in registry._counted_words(registry._docs(spark, str(tmp_path)), "doc_id").collect()) == [(1, "a", 1), (1, "b", 3), (1, "c", 1)]


def test_counts_are_scored_like_tokens_without_dealing_out_texts(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "c a")], "doc_id long, text string")
    table = spark.createDataFrame([("a", 30.0, 0.0), ("b", 1.0, 0.0)], "token string, or double, ref_rel_freq double")
    counted = registry._counted_words(docs, "doc_id")
    tok = registry._words(docs, "doc_id")
    rows = lambda t: sorted(map(tuple, keyness.jargon_density(t, table).collect()))
    assert rows(counted) == rows(tok) == [(1, 3, 1, 33.3333), (2, 2, 1, 50.0)]


def test_masked_places_of_sentences_are_those_of_tokens(spark):
    docs = spark.createDataFrame([(1, "One two three four five six seven eight. Nine two. Ten\n\nno one"), (2, "")], "doc_id long, text string")
    tok = annotate.tokens(docs)
    ranks = language_model.unigram_ranks(tok)
    rows = lambda t: sorted((r["doc_id"], round(r["lmfm"], 12)) for r in language_model.masked_rank(t, ranks, ratio=0.4).collect())
    assert rows(annotate.sentence_words(docs)) == rows(tok)
    assert "Window" not in language_model.masked_rank(annotate.sentence_words(docs), ranks)._jdf.queryExecution().optimizedPlan().toString()


def test_a_word_of_a_text_is_looked_up_once(spark):
    tok = annotate.tokens(spark.createDataFrame([(1, "a of a b 12 ."), (2, "...")], "doc_id long, text string"))
    freq = spark.createDataFrame([("a", 0.5), ("of", 0.25), ("b", 1.0)], "token string, rel double")
    got = metrics.word_freq(tok, freq)
    assert sorted(map(tuple, got.collect())) == [(1, 0.45, 1.0), (2, None, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_words_are_what_no_tag_calls_punctuation_or_symbol(spark):
    tok = annotate.tokens(spark.createDataFrame([(1, "İx a1 12 ٣4 ½ € . - é")], "doc_id long, text string"))
    old = (F.col("pos") != "PUNCT") & ~((F.col("pos") != "NUM") & ~F.col("text").rlike(r"\p{L}"))
    assert tok.where(F.col("is_word") != old).isEmpty()


def test_node_pairs_are_those_of_expanded_titles(spark):
    pairs = spark.createDataFrame([("s", "t"), ("s", "u"), ("t", "t"), ("t", "s")], "title_a string, title_b string")
    index = spark.createDataFrame([("s" if i % 3 else "t", f"n{i}") for i in range(40)] + [("u", "n1"), ("u", "z"), ("u", None)], "title string, node string")
    got = [tuple(r) for r in linkage.node_pairs(pairs, index, block=4).collect()]
    want = {tuple(r) for r in linkage.title_expand(pairs, index).select("a", "b").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_only_jargon_meets_the_words_of_texts(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "c a d")], "doc_id long, text string")
    table = spark.createDataFrame([("a", 30.0, 0.0), ("b", 1.0, 0.0), ("c", 30.0, 0.5), ("d", None, 0.0)], "token string, or double, ref_rel_freq double")
    tok = registry._counted_words(docs, "doc_id")
    for cut in (20.0, 0.5):  # below 1, words that the table lacks are jargon too
        every = keyness.jargon_terms(tok, table, cut).where("is_jargon")
        got = keyness.jargon_only(registry._words(docs, "doc_id"), table, cut)
        assert got.columns == every.columns and sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert "SortMergeJoin" not in keyness.jargon_density(tok, table)._jdf.queryExecution().executedPlan().toString()
