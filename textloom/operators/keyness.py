"""Two-corpus comparison of frequencies: contingency, effect sizes, merging, and domain-vocabulary density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.staging import staged
from textloom.sources import corpus

METRICS = ("ll", "or", "pd", "bf")


def frequencies(tok: DataFrame, token: str = "lemma") -> DataFrame:
    return tok.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("freq"))


def corpus_stats(freqs: DataFrame) -> DataFrame:
    return freqs.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"), F.count("*").alias("types"))


def transformed(freqs: DataFrame, lowercase: bool = True, strip: bool = True) -> DataFrame:
    t = F.trim("token") if strip else F.col("token")
    return freqs.groupBy((F.lower(t) if lowercase else t).alias("token")).agg(F.sum("freq").alias("freq"))


def percent_difference(a, b, c, d) -> Column:
    """Infinite where the reference corpus lacks the token."""
    ref = F.try_divide(b, b + d)
    return F.when(ref == 0, float("inf")).otherwise(100 * (F.try_divide(a, a + c) - ref) / F.when(ref != 0, ref))


def _term(x: Column, e: Column) -> Column:
    return F.when(x > 0, x * F.ln(F.try_divide(x, e))).otherwise(0.0)


def log_likelihood(a, b, c, d) -> Column:
    """Signed two-cell log-likelihood: negative where the study corpus has less of the token."""
    n1, n2 = a + c, b + d
    ll = 2 * (_term(a, n1 * (a + b) / (n1 + n2)) + _term(b, n2 * (a + b) / (n1 + n2)))
    return F.when(F.try_divide(a, n1) < F.try_divide(b, n2), -ll).otherwise(ll)


def g_test(a, b, c, d) -> Column:
    """Signed four-cell G with the continuity correction of one half towards the expected value."""
    n = a + b + c + d
    total = F.lit(0.0)
    for x, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = r * k / n
        y = x + F.signum(e - x) * F.least(F.lit(0.5), F.abs(e - x))
        total = total + _term(y, e)
    return F.when(F.try_divide(a, a + c) < F.try_divide(b, b + d), -2 * total).otherwise(2 * total)


def odds_ratio(a, b, c, d) -> Column:
    return F.try_divide(a * d, b * c)


def bayes_factor(a, b, c, d) -> Column:
    return log_likelihood(a, b, c, d) - F.ln(a + b + c + d)


FORMULAS = {"ll": log_likelihood, "or": odds_ratio, "pd": percent_difference, "bf": bayes_factor, "g": g_test}


def formula(name: str):
    """The measure of a name; unknown names are errors that list the known ones."""
    if name not in FORMULAS:
        raise ValueError(f"unknown metrics: [{name!r}]; known: {sorted(FORMULAS)}")
    return FORMULAS[name]


def totals(study: DataFrame, ref: DataFrame) -> DataFrame:
    """Totals and types of both lists as one row: sn, sk, rn, rk. Plans that also read the lists reuse their shuffles."""
    of = lambda df, n, k: df.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias(n), F.count("*").alias(k))
    return of(study, "sn", "sk").join(F.broadcast(of(ref, "rn", "rk")))  # one row each


def contingency(study: DataFrame, ref: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """Full outer union of tokens with cells a, b, c, d. The totals are one row, joined within the same plan."""
    if smoothing < 0:
        raise ValueError("smoothing must not be negative")
    j = study.withColumnRenamed("freq", "study_freq").join(ref.withColumnRenamed("freq", "ref_freq"), "token", "full_outer")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("study_freq", "ref_freq")}).join(F.broadcast(totals(study, ref)))  # one row
    k = F.lit(float(smoothing))
    return j.withColumns({
        "study_rel_freq": F.try_divide(F.col("study_freq").cast("double"), F.col("sn")), "ref_rel_freq": F.try_divide(F.col("ref_freq").cast("double"), F.col("rn")),
        "a": F.col("study_freq") + k, "b": F.col("ref_freq") + k, "c": F.col("sn") - F.col("study_freq") + k * F.col("sk"), "d": F.col("rn") - F.col("ref_freq") + k * F.col("rk")}).drop("sn", "sk", "rn", "rk")


def unknown_mass(study: DataFrame, ref: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """All tokens that only the reference has, as one row."""
    out = ref.join(study, "token", "left_anti").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("ref_freq"))
    out = out.join(F.broadcast(totals(study, ref)))  # one row each
    k = F.lit(float(smoothing))
    return out.select(F.lit("<unk>").alias("token"), "ref_freq", k.alias("a"), (F.col("ref_freq") + k).alias("b"), (F.col("sn") + k * F.col("sk")).alias("c"), (F.col("rn") - F.col("ref_freq") + k * F.col("rk")).alias("d"))


def compare(study: DataFrame, ref: DataFrame, metrics: tuple[str, ...] = METRICS, smoothing: float = 0.1) -> DataFrame:
    if unknown := set(metrics) - set(FORMULAS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    cells = [F.col(x) for x in "abcd"]
    return contingency(study, ref, smoothing).withColumns({m: FORMULAS[m](*cells) for m in metrics}).drop(*"abcd")


def renamed(df: DataFrame, name: str) -> DataFrame:
    study, ref = name.split("-v-") if name.count("-v-") == 1 else ("study", "reference")
    return df.withColumnsRenamed({"study_freq": f"abs-freq_{study}", "ref_freq": f"abs-freq_{ref}", **{m: f"{name}_{m}" for m in METRICS if m in df.columns}})


def merged(frames: dict[str, DataFrame], how: str = "outer", fill: float | None = None) -> DataFrame:
    """Comparisons aligned on token; ``fill`` replaces what a comparison lacks."""
    out = None
    for name, df in frames.items():
        one = renamed(df, name).withColumnsRenamed({"study_rel_freq": f"{name}_study_rel", "ref_rel_freq": f"{name}_ref_rel"})
        one = one.drop(*[c for c in one.columns if out is not None and c != "token" and c in out.columns])
        out = one if out is None else out.join(one, "token", "full_outer" if how == "outer" else "inner")
    return out if fill is None else out.fillna(fill)


def token_scores(tok: DataFrame, table: DataFrame, metric: str = "or") -> DataFrame:
    """Score of each token; those not in the table get 1 for an odds ratio, else 0."""
    t = table.select("token", F.col(metric).alias("_s"), "ref_rel_freq", F.lit(True).alias("_in"))
    return tok.join(t, "token", "left").withColumns({"score": F.coalesce("_s", F.lit(1.0 if metric == "or" else 0.0)), "in_dict": F.coalesce("_in", F.lit(False))}).drop("_s", "_in")


def counted_types(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, token, freq_in_text``. A table of counts (``annotate.word_counts``) stays as it is: one row a text and word."""
    if "n" in tok.columns:
        return tok.select(key, F.col("lemma").alias("token"), F.col("n").alias("freq_in_text"))
    return tok.groupBy(key, F.col("lemma").alias("token")).agg(F.count("*").alias("freq_in_text"))


def jargon_terms(tok: DataFrame, table: DataFrame, threshold: float = 20.0, metric: str = "or", ref_cut: float = 0.001, key: str = "doc_id") -> DataFrame:
    """Per document and type: score, frequency and whether it counts as jargon."""
    scored = token_scores(counted_types(tok, key), table, metric)
    return scored.withColumn("is_jargon", (F.col("score") > threshold) & (~F.col("in_dict") | (F.col("ref_rel_freq") <= ref_cut)))


def _jargon_of(table: DataFrame, threshold: float, metric: str, ref_cut: float) -> DataFrame | None:
    """The tokens of a table that are jargon, written; None where tokens that the table lacks are jargon too.

    They are few beside all tokens, and the planner knows the size of what is written: while it is small, the words of
    texts meet it where they lie; else both are shuffled.
    """
    if (1.0 if metric == "or" else 0.0) > threshold:
        return None
    s = F.coalesce(metric, F.lit(1.0 if metric == "or" else 0.0)).alias("score")
    return staged(table.select("token", s, "ref_rel_freq", F.lit(True).alias("in_dict"), F.lit(True).alias("is_jargon")).where((F.col("score") > threshold) & (F.col("ref_rel_freq") <= ref_cut)))


def _places(tok: DataFrame, key: str) -> DataFrame:
    """``key, token, _n`` of tokens or of counts, not counted further: few of them are kept."""
    return tok.select(key, F.col("lemma").alias("token"), (F.col("n") if "n" in tok.columns else F.lit(1).cast("long")).alias("_n"))


def jargon_only(tok: DataFrame, table: DataFrame, threshold: float = 20.0, metric: str = "or", ref_cut: float = 0.001, key: str = "doc_id") -> DataFrame:
    """The rows of ``jargon_terms`` that are jargon."""
    known = _jargon_of(table, threshold, metric, ref_cut)
    if known is None:
        return jargon_terms(tok, table, threshold, metric, ref_cut, key).where("is_jargon")
    found = _places(tok, key).join(known, "token").groupBy("token", key, *known.columns[1:]).agg(F.sum("_n").alias("freq_in_text"))
    return found.select("token", key, "freq_in_text", "ref_rel_freq", "score", "in_dict", "is_jargon")


def jargon_density(tok: DataFrame, table: DataFrame, threshold: float = 20.0, ref_cut: float = 0.001, key: str = "doc_id") -> DataFrame:
    known = _jargon_of(table, threshold, "or", ref_cut)
    t = jargon_terms(tok, table, threshold, "or", ref_cut, key) if known is None else _places(tok, key).withColumnRenamed("_n", "freq_in_text").join(known.select("token", "is_jargon"), "token", "left")
    n, j = F.sum("freq_in_text"), F.coalesce(F.sum(F.when(F.col("is_jargon"), F.col("freq_in_text"))), F.lit(0))
    return t.groupBy(key).agg(n.alias("total_tokens"), j.alias("jargon_count"), F.round(F.try_divide(100.0 * j, n), 4).alias("jargon_per_100"))


# The comparison that tells a language's jargon; scores of different languages do not compare.
COMPARISONS = {"de": "drks-v-deleipzig", "en": "pubmed-v-enleipzig"}
KNOWN_COMPARISONS = ("drks-v-deleipzig", "pubmed-v-enleipzig", "drks-v-pubmed", "deleipzig-v-enleipzig")


def validated(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Comparisons as they are; one without a token column is an error."""
    if bad := [n for n, df in frames.items() if "token" not in df.columns]:
        raise ValueError(f"no token column in {bad}")
    return frames


class JargonDetector:
    """A keyness table with the questions asked of it. Tokens are looked up as they are, or in lower case."""

    def __init__(self, table: DataFrame, lower: bool = False):
        validated({"table": table})
        self.table, self.lower = table, lower

    @classmethod
    def read(cls, spark, folder: str, comparison: str, preprocessing: str = "default") -> "JargonDetector":
        """The table at ``folder/preprocessing/comparison.tsv``."""
        if preprocessing not in ("default", "lower"):
            raise ValueError(f"unknown preprocessing: {preprocessing}")
        path = f"{folder}/{preprocessing}/{comparison}.tsv"
        if not corpus.exists(spark, path):
            raise FileNotFoundError(path)
        df = corpus.table(spark, path)
        number = [c for c in df.columns if c != "token"]
        return cls(df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in number}), preprocessing == "lower")

    def _own(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, F.lower(column)) if self.lower else df

    def identify(self, words: DataFrame, metric: str = "or") -> DataFrame:
        """``word, score, metric, in_dict`` of a table of words, one row a row."""
        got = token_scores(self._own(words.withColumn("token", F.col("word")), "token"), self.table, metric)
        return got.select("word", "score", F.lit(metric).alias("metric"), "in_dict")

    def compare(self, words: DataFrame, metric: str = "or") -> DataFrame:
        """Words by falling score; ties in code-point order."""
        return self.identify(words, metric).orderBy(F.desc("score"), "word")

    def analyze(self, tok: DataFrame, metric: str = "or", threshold: float | None = None, key: str = "doc_id") -> DataFrame:
        """Every distinct token of each text: score, frequency, whether the score exceeds the threshold (20 for odds
        ratios, else 0), and its place by falling score."""
        cut = threshold if threshold is not None else 20.0 if metric == "or" else 0.0
        got = token_scores(counted_types(self._own(tok, "lemma"), key), self.table, metric).withColumn("is_jargon", F.col("score") > cut)
        return got.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "token"))).drop("ref_rel_freq")

    def terms(self, tok: DataFrame, threshold: float = 20.0, metric: str = "or", ref_cut: float = 0.001, limit: int | None = None, key: str = "doc_id") -> DataFrame:
        """Jargon of each text by falling score, at most ``limit`` a text where a limit is given."""
        got = jargon_only(self._own(tok, "lemma"), self.table, threshold, metric, ref_cut, key)
        got = got.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "token")))
        return got if limit is None else got.where(F.col("place") <= limit)


def jargon_by_language(tok: DataFrame, tables: dict[str, DataFrame], threshold: float = 20.0, ref_cut: float = 0.001, key: str = "doc_id", language: str = "language") -> DataFrame:
    """Density of every text by its own language's table; texts of languages without one are left out."""
    out = None
    for lang, table in sorted(tables.items()):
        one = jargon_density(tok.where(F.col(language) == lang), table, threshold, ref_cut, key).withColumn(language, F.lit(lang))
        out = one if out is None else out.unionByName(one)
    return out
