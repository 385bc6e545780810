"""An interpolated Kneser-Ney model of orders one to three, as tables of counts and back-off weights.

All tables come from the distinct trigrams of the corpus. Lower orders count contexts instead of occurrences: a bigram how
many words precede it (its occurrences, if it begins a sentence), a word how many words precede it. Each order has one
discount, ``n1 / (n1 + 2 n2)`` of the counts that occur once and twice (a half if none occurs once), and gives what it takes
to the order below; the lowest shares with the uniform law over all types and one unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.staging import staged

START = "<s>"


@dataclass(frozen=True)
class Model:
    """``tri``: u, v, w, c; ``bi``: v, w, c; ``uni``: w, c; sums and numbers of types by context; ``size``: one row of totals
    and discounts."""

    tri: DataFrame
    bi: DataFrame
    uni: DataFrame
    after_two: DataFrame
    after_one: DataFrame
    size: DataFrame


def trigrams(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, sent_id, tok_i, u, v, w``: every token with the two before it in its sentence."""
    order = Window.partitionBy(key, "sent_id").orderBy("tok_i")
    before = lambda n: F.coalesce(F.lag("lemma", n).over(order), F.lit(START))
    return tok.select(key, "sent_id", "tok_i", before(2).alias("u"), before(1).alias("v"), F.col("lemma").alias("w"))


def _discount(counts: DataFrame, name: str) -> DataFrame:
    n1, n2 = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    return counts.agg(F.when(n1 > 0, n1.cast("double") / (n1 + 2 * n2)).otherwise(0.5).alias(name))


def fit(tok: DataFrame, key: str = "doc_id") -> Model:
    """The model of a token table. An empty one has no types, and its model gives every word probability one."""
    tri = staged(trigrams(tok, key).groupBy("u", "v", "w").agg(F.count("*").alias("c")))
    # Trigrams are distinct, so their rows are the distinct words before a bigram.
    bi = staged(tri.groupBy("v", "w").agg(F.when(F.col("v") == START, F.sum("c")).otherwise(F.count("*")).alias("c")))
    uni = staged(bi.groupBy("w").agg(F.count("*").alias("c")))
    context = lambda t, *by: t.groupBy(*by).agg(F.sum("c").alias("s"), F.count("*").alias("t"))
    total = uni.agg(F.sum("c").alias("s1"), F.count("*").alias("t1"))
    size = total.join(_discount(tri, "d3")).join(_discount(bi, "d2")).join(_discount(uni, "d1"))  # one row each
    return Model(tri, bi, uni, staged(context(tri, "u", "v")), staged(context(bi, "v")), staged(size))


def _interpolated(c: Column, s: Column, t: Column, d: Column, below: Column) -> Column:
    """One order's probability; that of the order below where the context is unknown."""
    return F.when(s.isNull(), below).otherwise(F.greatest(F.coalesce(c, F.lit(0)) - d, F.lit(0.0)) / s + d * t / s * below)


def probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """``u, v, w, p`` of distinct trigrams, seen or not."""
    j = asked.select("u", "v", "w").distinct()
    j = j.join(model.uni.withColumnRenamed("c", "c1"), "w", "left").join(model.bi.withColumnRenamed("c", "c2"), ["v", "w"], "left").join(model.tri.withColumnRenamed("c", "c3"), ["u", "v", "w"], "left")
    j = j.join(model.after_one.withColumnsRenamed({"s": "s2", "t": "t2"}), "v", "left").join(model.after_two.withColumnsRenamed({"s": "s3", "t": "t3"}), ["u", "v"], "left")
    j = j.crossJoin(F.broadcast(model.size))  # one row
    one = _interpolated(F.col("c1"), F.col("s1"), F.col("t1"), F.col("d1"), 1 / (F.col("t1") + 1))
    two = _interpolated(F.col("c2"), F.col("s2"), F.col("t2"), F.col("d2"), one)
    return j.select("u", "v", "w", F.coalesce(_interpolated(F.col("c3"), F.col("s3"), F.col("t3"), F.col("d3"), two), F.lit(1.0)).alias("p"))


def sentence_loss(tok: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, sent_id, n, loss``: mean negative log-probability of each sentence's tokens, for ``language_model.perplexities``."""
    at = staged(trigrams(tok, key))
    p = probabilities(at, model).select("u", "v", "w", (-F.ln("p")).alias("_l"))
    return at.join(p, ["u", "v", "w"]).groupBy(key, "sent_id").agg(F.count("*").alias("n"), F.avg("_l").alias("loss"))
