"""Documents to tokens: sentences, tokens, tags, lemmas, heads and syllables by rules, inside the JVM.

A provider with better annotations (a tagger, a parser) only has to return the same columns. The rules here need no
model: a sentence ends at a line break or after ``. ! ?``; a token is a run of letters and digits or a single other
character; tags come from word lists and endings; a token hangs on the one before it, unless that is punctuation.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import ship

# Word lists of the rule annotator.
DETERMINERS = ("the", "a", "an", "this", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une", "el", "los", "las")
ADPOSITIONS = ("of", "in", "on", "at", "by", "for", "with", "to", "from", "von", "zu", "mit", "auf", "de", "en", "pour", "con", "por")
AUXILIARIES = ("is", "are", "was", "be", "been", "ist", "sind", "war", "est", "sont", "es", "son")
CONJUNCTIONS = ("and", "or", "but", "und", "oder", "et", "ou", "y", "o")
STOPS = DETERMINERS + ADPOSITIONS + AUXILIARIES + CONJUNCTIONS
NEGATIONS = {"de": ("nicht", "kein", "nie", "nein", "keineswegs", "keinesfalls", "nichts", "nirgends", "nimmer", "niemand", "nirgendwo", "niemals"),
             "en": ("not", "no", "never", "neither", "nor", "nobody", "nothing", "nowhere", "none")}
# The fine German tags among them never equal a coarse tag; languages without a set take the German one.
FUNCTION_TAGS = {"de": ("AUX", "DET", "ADP", "VMFIN", "VMINF", "VMPP", "PWS", "PWAT", "PWAV"),
                 "en": ("AUX", "DET", "ADP", "CCONJ", "SCONJ", "PART", "PRON")}
PUNCTUATION = ".,;:!?()'\"-"
SENTENCE = r"[^.!?\n]+[.!?]*|[.!?]+"
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\r\f\x0B\p{L}\p{N}]"
SOCIAL = (r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[:;=8][-o']?[()\[\]dDpP/]|[#@][\p{L}\p{N}_]+|"
          r"\p{N}+(?:[.,:]\p{N}+)*|(?:\p{L}\.){2,}|[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]")
VOWELS = "[aeiouyäöüáàâéèêíîóôúùû]+"


def _ends(text: Column, *endings: str) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.endswith(text, F.lit(e)) for e in endings))


def tag(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(text.rlike(r"^\p{N}+$"), "NUM").when(~text.rlike(r"[\p{L}\p{N}]"), F.when(F.lit(PUNCTUATION).contains(text), "PUNCT").otherwise("SYM"))
            .when(low.isin(*DETERMINERS), "DET").when(low.isin(*ADPOSITIONS), "ADP").when(low.isin(*AUXILIARIES), "AUX").when(low.isin(*CONJUNCTIONS), "CCONJ")
            .when(_ends(low, "ing", "ed", "en", "er"), "VERB").when(_ends(low, "ly", "lich", "ment"), "ADJ").otherwise("NOUN"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """``key, keep, sent_id, sentence``: numbered from 0, blank ones dropped before numbering."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select(key, *keep, F.posexplode(found).alias("sent_id", "sentence"))


def sentence_words(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """``key, keep, sent_id, words``: the tokens of every sentence that has any as one array, for measures of whole sentences:
    what they ask of neighbours is then found in the array, and no table of tokens is sorted."""
    sent = sentences(docs.select(key, *keep, text), key, text, *keep)
    return sent.select(key, *keep, "sent_id", F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)).alias("words")).where(F.size("words") > 0)


def text_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sents``: every text's sentences, each as the array of its tokens, which may be empty."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    return docs.where(F.col(text).isNotNull()).select(key, F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))).alias("sents"))


def is_punct(text: Column) -> Column:
    """What ``tag`` calls PUNCT."""
    return ~text.rlike(r"[\p{L}\p{N}]") & F.lit(PUNCTUATION).contains(text)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """The canonical token table; ``keep`` names further columns of ``docs`` to carry."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    sent = docs.select(key, *keep, F.posexplode(found).alias("sent_id", "sentence"))
    tok = sent.select(key, *keep, "sent_id", F.posexplode(F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))).alias("tok_i", "text"))
    t = F.col("text")
    tok = tok.withColumns({"lemma": F.lower(t), "pos": tag(t), "is_alpha": t.rlike(r"^\p{L}+$"), "is_stop": F.lower(t).isin(*STOPS),
                           "syllables": F.regexp_count(F.lower(t), F.lit(VOWELS)).cast("int")})
    # A word is what has a letter or is a number: the same as neither PUNCT nor a symbol, without the cost of a tag.
    return tok.withColumns({"is_punct": F.col("pos") == "PUNCT", "is_word": t.rlike(r"\p{L}|^\p{N}+$")})


def word_counts(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """``keep, lemma, n``: the distinct words of each row's array with their number, for what is summed by word and text.

    An array is sorted and cut where a word differs from the one before it, so no task holds a table of the words of many
    texts and no token is shuffled. Rows are counted one by one: texts that share a key are summed by who asks.
    """
    w = F.col("_w")
    sorted_ = docs.select(*keep, F.sort_array(words).alias("_w")).where(F.size("_w") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    at = sorted_.select(*keep, "_w", first.alias("_f"))
    f = F.col("_f")
    run = lambda i, k: F.struct(F.get(w, i).alias("lemma"), (F.coalesce(F.get(f, k + 1), F.size(w)) - i).cast("long").alias("n"))
    return at.select(*keep, F.inline(F.transform(f, run)))


def social_tokens(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """``keep, i, token``: a tokeniser for web text, one for all languages: links, addresses, emoticons, tags, words with
    inner hyphens and apostrophes, numbers with separators, abbreviations, and single other characters are tokens."""
    found = F.regexp_extract_all(text, F.lit(SOCIAL), F.lit(0))
    return docs.select(*keep, F.posexplode(found).alias("i", "token"))


def treebank_tokens(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The same for English reference corpora: contractions part from their words (don't: do, n't; it's: it, 's)."""
    parted = F.regexp_replace(F.regexp_replace(text, r"(?i)([a-z])(n['’]t)\b", "$1 $2"), r"(?i)([a-z])(['’](?:s|re|ve|ll|d|m))\b", "$1 $2")
    found = F.regexp_extract_all(parted, F.lit(r"(?i)n['’]t\b|['’](?:s|re|ve|ll|d|m)\b|(?:(?!n['’]t\b)[\p{L}\p{N}])+(?:[-.](?:(?!n['’]t\b)[\p{L}\p{N}])+)*|[^\s\p{L}\p{N}]"), F.lit(0))
    return docs.select(*keep, F.posexplode(found).alias("i", "token"))


def search_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", lemma=None) -> DataFrame:
    """``key, i, term, start, end``: terms of a search index with byte offsets of their words in the text.

    ``lemma`` makes a term of a word's column (default: lower case); a lemma ``--`` falls back to the word. Words and the
    gaps between them alternate, so offsets are running sums over one text's array; no token is shuffled or sorted. Texts are told apart by rows, not by key.
    """
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    cut = docs.where(F.col(text).isNotNull()).select(key, words.alias("_w"), F.zip_with(words, F.slice(gaps, 1, F.size(gaps) - 1), lambda w, g: F.octet_length(g) + F.octet_length(w)).alias("_n"))
    ship(docs.sparkSession)
    ends = cut.select(key, "_w", F.arrow_udf(_running, "array<int>")("_n").alias("_e"))
    rows = ends.select(key, F.posexplode(F.zip_with("_w", "_e", lambda w, e: F.struct(w.alias("w"), e.alias("e")))).alias("i", "x"))
    w, end = F.col("x.w"), F.col("x.e")
    made = lemma(w) if lemma else F.lower(w)
    return rows.select(key, "i", F.when(made == "--", w).otherwise(made).alias("term"), (end - F.octet_length(w)).alias("start"), end.alias("end"))


def _running(sizes: pa.Array) -> pa.Array:
    """Running sums within each list."""
    at = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    total = np.append(0, np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64))
    own = total[1:] - np.repeat(total[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own, pa.int32()))


def token_sql(keep: str = "") -> str:
    """The same table as a DuckDB CTE list ``tok``; ``keep`` is a prefix list such as ``lang, ``."""
    q = lambda xs: ", ".join("'" + x + "'" for x in xs)
    punct = PUNCTUATION.replace("'", "''")
    return rf"""sen AS (SELECT doc_id, {keep}list_filter(list_transform(regexp_extract_all(text, '{SENTENCE}'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents),
sx AS (SELECT doc_id, {keep}unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_id FROM sen),
tl AS (SELECT doc_id, {keep}sent_id, regexp_extract_all(sentence, '{TOKEN}') AS ts FROM sx),
t0 AS (SELECT doc_id, {keep}sent_id, unnest(ts) AS text, unnest(range(len(ts))) AS tok_i FROM tl),
t1 AS (SELECT *, lower(text) AS lemma, regexp_matches(text, '^\p{{L}}+$') AS is_alpha, lower(text) IN ({q(STOPS)}) AS is_stop,
  len(regexp_extract_all(lower(text), '{VOWELS}')) AS syllables,
  CASE WHEN regexp_matches(text, '^\p{{N}}+$') THEN 'NUM' WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN CASE WHEN contains('{punct}', text) THEN 'PUNCT' ELSE 'SYM' END
  WHEN lower(text) IN ({q(DETERMINERS)}) THEN 'DET' WHEN lower(text) IN ({q(ADPOSITIONS)}) THEN 'ADP' WHEN lower(text) IN ({q(AUXILIARIES)}) THEN 'AUX'
  WHEN lower(text) IN ({q(CONJUNCTIONS)}) THEN 'CCONJ' WHEN regexp_matches(lower(text), '(ing|ed|en|er)$') THEN 'VERB' WHEN regexp_matches(lower(text), '(ly|lich|ment)$') THEN 'ADJ' ELSE 'NOUN' END AS pos FROM t0),
tok AS (SELECT *, pos = 'PUNCT' AS is_punct, pos <> 'PUNCT' AND (pos = 'NUM' OR regexp_matches(text, '\p{{L}}')) AS is_word FROM t1)"""
