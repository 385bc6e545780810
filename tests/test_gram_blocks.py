"""N-gram losses by blocks: equal to those of the table of tokens, and no place is shuffled."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import annotate, drivers, gram_blocks, language_model, ngrams
from textloom.plans import learned, registry, reports

DATA = "/root/testdata/sf0.001"
ODD = [(1, "One, two three. Four!\n\t\n ... ? (a) b.c"), (2, ""), (3, None), (4, "x"), (5, "Ärger — ½ 12 12. Straße, STRASSEİ - -"), (None, "no key. At all"), (6, "\t. \n\t"), (7, "a b a. a b c"), (7, "a b a. a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i if i is None else 10**6 + i, t) for i, t in ODD], "doc_id long, text string")
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd)


def rows(df):
    return sorted((tuple(x if x is None or isinstance(x, int) else float(f"{x:.9g}") for x in r) for r in df.collect()), key=str)


def test_pair_losses_equal_those_of_tokens(docs, monkeypatch):
    monkeypatch.setattr(gram_blocks, "PART", 1 << 16)  # many parts
    tok = annotate.tokens(docs)
    assert rows(gram_blocks.bigram_loss(docs)) == rows(language_model.sentence_loss(tok, language_model.fit(tok)))


def test_triple_losses_equal_those_of_tokens(docs, monkeypatch):
    monkeypatch.setattr(gram_blocks, "PART", 1 << 16)
    tok = annotate.tokens(docs)
    assert rows(gram_blocks.trigram_loss(docs)) == rows(ngrams.sentence_loss(tok, ngrams.fit(tok)))
    assert rows(gram_blocks.trigram_loss(docs.where("false"))) == []


def test_no_texts_give_no_rows(docs):
    assert rows(gram_blocks.bigram_loss(docs.where("false"))) == [] == rows(gram_blocks.bigram_loss(docs.where("doc_id in (1000002, 1000003)")))


def test_model_measures_of_texts_equal_those_of_tokens(docs):
    one = docs.where("doc_id is null or doc_id <> 1000007")
    assert rows(drivers.model_measures(one)) == rows(drivers.model_measures(annotate.tokens(one)))


@pytest.mark.parametrize("name", ["bigram_perplexity", "trigram_perplexity", "model_measures"])
def test_no_place_is_sorted_or_joined(spark, name):
    plan = (registry.queries() | reports.queries() | learned.queries())[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "before" not in plan and "collect_set" not in plan and "lag(" not in plan
    assert name == "model_measures" or "Join" not in plan  # that one joins rows of texts
