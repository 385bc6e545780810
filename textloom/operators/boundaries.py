"""Abbreviations and sentence starters learned from a corpus without labels, and sentences split by them.

Words are runs of non-blanks. A word that ends in a period either is an abbreviation or ends a sentence; log-likelihood
ratios over the corpus tell which: short words, with inner periods, that hardly ever stand without the final one are
abbreviations (Kiss and Strunk's statistics, with their published constants). A word that follows sentence ends far more
often than chance is a starter, and pairs that hold together across a period are collocations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.staging import staged

# Published thresholds of the method.
ABBREVIATION, STARTER, COLLOCATION, RARE = 0.3, 30.0, 7.88, 0.99
BLANKS = r"[^ \t\n\r\f\x0B]+"
OPENING, CLOSING = r"^[\"'(\[{„“‚‘«»]+", r"[\"')\]},;:“”’«»]+\z"
NUMBER = "##number##"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, i, word, bare, type, period``: words in order; ``bare`` without quotes and brackets, ``type`` in lower case
    without its final period, digits as one type."""
    w = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(BLANKS), F.lit(0))).alias("i", "word"))
    w = w.withColumn("bare", F.regexp_replace(F.regexp_replace("word", OPENING, ""), CLOSING, ""))
    low = F.lower(F.regexp_replace("bare", r"\.\z", ""))
    return w.withColumns({"period": F.endswith("bare", F.lit(".")) & (F.length("bare") > 1),
                          "type": F.when(low.rlike(r"^[-+]?\p{N}+([.,]\p{N}+)*\z"), NUMBER).otherwise(low)})


def counted(w: DataFrame, key: str = "doc_id") -> DataFrame:
    """``type, period, next, c``: how often each type, with its final period or without, precedes each type in a text (null:
    ends it). Written once: all statistics come from these counts, so words are cut once for all of them."""
    s = w.select("type", "period", F.lead("type").over(Window.partitionBy(key).orderBy("i")).alias("next"))
    return staged(s.groupBy("type", "period", "next").agg(F.count("*").alias("c")))


def _sum_if(test: Column | str, c: str = "c") -> Column:
    return F.coalesce(F.sum(F.when(F.col(test) if isinstance(test, str) else test, F.col(c))), F.lit(0))


def abbreviations(w: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``type, n, n_period, score, abbreviation``: the statistics of every type that ends in a period somewhere.

    Numbers are no abbreviations; whether they end a sentence, their successor tells. ``counts`` (here and below): the words'
    ``counted``, where several statistics share them.
    """
    if counts is None:
        c = w.where("type <> ''").groupBy("type").agg(F.count("*").alias("n"), F.count_if("period").alias("n_period"))
    else:
        c = counts.where("type <> ''").groupBy("type").agg(F.sum("c").alias("n"), _sum_if("period").alias("n_period"))
    total = c.agg(F.sum("n").alias("_all"), F.sum("n_period").alias("_periods"))
    j = c.where(F.col("n_period") > 0).crossJoin(F.broadcast(total))  # one row
    k, n = F.col("n_period").cast("double"), F.col("n").cast("double")
    chance = F.least(F.col("_periods") / F.col("_all"), F.lit(RARE))
    fit = lambda p: k * F.ln(p) + (n - k) * F.ln(1 - p)
    ratio = -2 * (fit(chance) - fit(F.lit(RARE)))
    letters = F.length(F.regexp_replace("type", r"\.", "")).cast("double")
    inner = F.length("type") - letters + 1
    penalty = F.when(letters > 0, F.pow(letters, k - n)).otherwise(0.0)
    score = ratio * F.exp(-letters) * inner * penalty
    known = (score >= ABBREVIATION) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}")
    return j.select("type", "n", "n_period", score.alias("score"), known.alias("abbreviation"))


def association(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events that occur a, b and together ab times among n."""
    p = b / n
    p1 = F.try_divide(ab, a)
    p2 = F.try_divide(b - ab, n - a)
    term = lambda k, m, q: F.when(k > 0, k * F.ln(q)).otherwise(0.0) + F.when(m - k > 0, (m - k) * F.ln(1 - q)).otherwise(0.0)
    return -2 * (term(ab, a, p) + term(b - ab, n - a, p) - term(ab, a, p1) - term(b - ab, n - a, p2))


def _short(s: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``short``, whether a word or a count of words is of an abbreviation."""
    return s.join(known.where("abbreviation").select("type", F.lit(True).alias("short")), "type", "left").withColumn("short", F.coalesce("short", F.lit(False)))


def starters(w: DataFrame, known: DataFrame, key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """``type, n, n_after, score, starter``: words that follow a period of no abbreviation or number more often than chance."""
    s = _short(counted(w, key) if counts is None else counts, known).where("type <> ''")
    ends = F.col("period") & ~F.col("short") & (F.col("type") != NUMBER)
    after = s.where(ends & F.col("next").rlike(r"\p{L}")).groupBy(F.col("next").alias("type")).agg(F.sum("c").alias("n_after"))
    total = s.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_all"), _sum_if(ends).alias("_ends"))
    n = s.groupBy("type").agg(F.sum("c").alias("n"))
    j = n.join(after, "type").crossJoin(F.broadcast(total))  # one row
    d = lambda c: F.col(c).cast("double")
    score = association(d("n"), d("_ends"), F.least(d("n_after"), d("n")), d("_all"))
    more = d("n_after") / d("n") > d("_ends") / d("_all")
    return j.select("type", "n", "n_after", score.alias("score"), ((score >= STARTER) & more).alias("starter"))


def collocations(w: DataFrame, known: DataFrame, key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """``type, next, n, score, collocation``: pairs around the period of an abbreviation or a number that belong together."""
    s = _short(counted(w, key) if counts is None else counts, known).where("type <> ''")
    pairs = s.where(F.col("period") & (F.col("short") | (F.col("type") == NUMBER)) & F.col("next").rlike(r"\p{L}")).groupBy("type", "next").agg(F.sum("c").alias("n"))
    one = s.groupBy("type").agg(F.sum("c").alias("c"))
    j = pairs.join(one.withColumnRenamed("c", "a"), "type").join(one.withColumnsRenamed({"c": "b", "type": "next"}), "next").crossJoin(F.broadcast(one.agg(F.sum("c").alias("_all"))))
    d = lambda c: F.col(c).cast("double")
    score = association(d("a"), d("b"), F.least(d("n"), d("a"), d("b")), d("_all"))
    more = d("n") / d("a") > d("b") / d("_all")
    return j.select("type", "next", "n", score.alias("score"), ((score >= COLLOCATION) & more & (F.col("n") > 1)).alias("collocation"))


def sentences(w: DataFrame, known: DataFrame, begin: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, sent_id, sentence``: the words of each sentence joined by blanks, numbered from 0.

    ``! ?`` always end a sentence. The period of an abbreviation or a number does so before a starter in upper case only,
    and never in a collocation; any other period does unless a word in lower case follows.
    """
    order = Window.partitionBy(key).orderBy("i")
    s = _short(w.withColumns({"next": F.lead("type").over(order), "next_bare": F.lead("bare").over(order)}), known)
    s = s.join(begin.where("starter").select(F.col("type").alias("next"), F.lit(True).alias("begins")), "next", "left")
    s = s.join(pairs.where("collocation").select("type", "next", F.lit(True).alias("holds")), ["type", "next"], "left")
    upper = F.col("next_bare").rlike(r"^\p{Lu}")
    careful = F.col("short") | (F.col("type") == NUMBER)
    ends = F.col("bare").rlike(r"[!?]\z") | (F.col("period") & F.when(careful, upper & F.coalesce("begins", F.lit(False)) & F.col("holds").isNull()).otherwise(~F.coalesce(F.col("next_bare").rlike(r"^\p{Ll}"), F.lit(False))))
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("sent_id", F.coalesce(F.sum(ends.cast("int")).over(order), F.lit(0)))
    return s.groupBy(key, "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("sentence"))
