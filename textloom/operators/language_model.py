"""Language-model measures with a bigram model as the default provider: cross-entropy by joins, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import annotate
from textloom.operators.staging import staged


def bigrams(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key, "sent_id").orderBy("tok_i")
    return tok.select(key, "sent_id", "tok_i", F.coalesce("lemma", F.lit("")).alias("lemma"), F.coalesce(F.lag("lemma").over(w), F.lit("<s>")).alias("before"))


def _pairs(at: DataFrame) -> DataFrame:
    """Counts of pairs. The test of the count is always true: with it, every use shares one shuffle of the counts."""
    return at.groupBy("before", "lemma").agg(F.count("*").alias("c2")).where("c2 > 0")


def fit(tok: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of pairs (before, lemma, c2), of their first members (before, c1), and the number of types (one row, v).

    All come from the pair counts: a lemma is the second member of some pair, so the types are theirs.
    """
    two = _pairs(bigrams(tok, key))
    return two, two.groupBy("before").agg(F.sum("c2").alias("c1")), two.select("lemma").distinct().agg(F.count("lemma").alias("v"))


def sentence_loss(tok: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], add: float = 0.1, key: str = "doc_id") -> DataFrame:
    """``key, sent_id, n, loss``: mean negative log-probability with additive smoothing.

    Probabilities are made once for each distinct pair, so places take part in one join only.
    """
    two, one, size = model
    at = bigrams(tok, key)
    pairs = _pairs(at).select("before", "lemma").join(two, ["before", "lemma"], "left").join(one, "before", "left").join(F.broadcast(size))  # one row
    p = (F.coalesce("c2", F.lit(0)) + add) / (F.coalesce("c1", F.lit(0)) + add * F.col("v"))
    j = at.join(pairs.select("before", "lemma", (-F.ln(p)).alias("_l")), ["before", "lemma"])
    return j.groupBy(key, "sent_id").agg(F.count("*").alias("n"), F.avg("_l").alias("loss"))


def perplexities(loss: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Mean and median of sentence perplexities, with and without short sentences, and that of the whole text."""
    e = F.exp("loss")
    long = F.col("n") >= least
    return loss.groupBy(key).agg(F.avg(F.when(long, e)).alias("appl_filtered_mean"), F.median(F.when(long, e)).alias("appl_filtered_median"), F.avg(e).alias("appl_full_mean"), F.median(e).alias("appl_full_median"),
                                 F.exp(F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("appl_fulltext"))


def adjacent_overlap(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of neighbouring sentences that share a content lemma: the default next-sentence provider.

    ``tok`` may be a table of texts with their sentences as arrays of words (``annotate.text_sentences``): then neighbours are
    met in the array, and neither tokens nor sentences are gathered or sorted.
    """
    if "sents" in tok.columns:
        content = lambda w: F.array_distinct(F.transform(F.filter(w, lambda x: x.rlike(r"^\p{L}+$") & ~F.lower(x).isin(*annotate.STOPS)), F.lower))
        own = tok.select(key, F.transform(F.filter("sents", lambda w: F.size(w) > 0), content).alias("_s")).where(F.size("_s") > 1)
        met = F.size(F.filter(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.arrays_overlap(F.get("_s", i), F.get("_s", i - 1))))
        return own.select(key, met.alias("_m"), (F.size("_s") - 1).alias("_n")).groupBy(key).agg((F.sum("_m") / F.sum("_n")).alias("ansp"))
    s = tok.where("is_alpha and not is_stop").groupBy(key, "sent_id").agg(F.collect_set("lemma").alias("l"))
    every = tok.select(key, "sent_id").distinct().join(s, [key, "sent_id"], "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    nxt = every.withColumn("m", F.lead("l").over(Window.partitionBy(key).orderBy("sent_id"))).where("m is not null")
    return nxt.groupBy(key).agg(F.avg(F.arrays_overlap("l", "m").cast("double")).alias("ansp"))


def masked_rank(tok: DataFrame, unigrams: DataFrame, ratio: float = 0.15, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Mean relative rank of masked tokens: max(1, round(ratio * n)) of each sentence, chosen by a seeded hash.

    ``unigrams``: token, rank (1 the most frequent); unknown tokens rank last. ``tok`` may be a table of sentences
    (``annotate.sentence_words``): then each array is sorted by itself, and only masked tokens become rows.
    """
    if "words" in tok.columns:
        place = lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sent_id").cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i"), F.lower(x).alias("w"))
        dealt = tok.select(key, F.sort_array(F.transform("words", place)).alias("_p"))
        some = F.slice("_p", 1, F.greatest(F.lit(1), F.round(F.size("_p") * ratio).cast("int")))
        return _mean_rank(dealt.select(key, F.explode(some).alias("_p")).select(key, F.col("_p.w").alias("lemma")), unigrams, key)
    w = Window.partitionBy(key, "sent_id")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sent_id").cast("string"), F.col("tok_i").cast("string")).cast("binary"))
    t = tok.withColumns({"_n": F.count("*").over(w), "_h": F.row_number().over(w.orderBy(h, "tok_i"))})
    m = t.where(F.col("_h") <= F.greatest(F.lit(1), F.round(F.col("_n") * ratio)))
    return _mean_rank(m, unigrams, key)


def _mean_rank(masked: DataFrame, unigrams: DataFrame, key: str) -> DataFrame:
    j = masked.join(unigrams.withColumnRenamed("token", "lemma"), "lemma", "left").join(F.broadcast(unigrams.agg(F.count("*").alias("_v"))))  # one row
    return j.groupBy(key).agg(F.avg(F.coalesce("rank", "_v") / F.col("_v")).alias("lmfm"))


def unigram_ranks(tok: DataFrame) -> DataFrame:
    """``token, rank`` (1 the most frequent, ties alike), from the number of types of each larger frequency."""
    f = staged(tok.groupBy(F.col("lemma").alias("token")).agg(F.count("*").alias("freq")))  # one pass over the tokens
    c = f.groupBy("freq").agg(F.count("*").alias("c"))
    # There are few distinct frequencies: their number grows with the root of the corpus at most.
    c = c.select("freq", (1 + F.coalesce(F.sum("c").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("rank"))
    return staged(f.join(c, "freq").select("token", "rank"))


def simplify(docs: DataFrame, max_words: int = 12, text: str = "text") -> DataFrame:
    """The default rewriting provider: sentences of more words are cut at their commas and semicolons."""
    sents = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*|[.!?]+"), F.lit(0))
    cut = F.transform(sents, lambda s: F.when(F.size(F.split(F.trim(s), " +")) > max_words, F.regexp_replace(s, r"[,;] +", ". ")).otherwise(s))
    return docs.withColumn("simplified_text", F.array_join(F.transform(cut, lambda s: F.trim(s)), " "))
