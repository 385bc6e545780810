"""All registered queries of the analytics operators and their SQL.

The tables stand in for a corpus: documents are articles, benchmark is the reference corpus, doc_id modulo small numbers
makes clusters, tiers and pairs (as data, not as filters), embeddings are vectors, pages are web pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import annotate, gram_blocks, index, keyness, language_model, linkage, metrics, search, stats, vocabulary
from textloom.operators.staging import staged
from textloom.sources import corpus

TOK = annotate.token_sql()
TOKL = annotate.token_sql("lang, ")
WORDS = r"'[\p{L}\p{N}]+'"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of floats depend on their order, so reports are rounded."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return table(s, d, "documents")


def _spread(df: DataFrame) -> DataFrame:
    """Texts dealt out by document before the heavy projection: so their tokens, an order more bytes, are grouped where they lie."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _tok(s, d, *keep):
    return annotate.tokens(_spread(_docs(s, d)), "doc_id", "text", *keep)


def _sents(s, d):
    return annotate.sentence_words(_spread(_docs(s, d)))


def _words(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("lemma"))


def _freqs(s, d):
    low = lambda df: df.withColumn("lemma", F.lower("lemma"))
    return keyness.frequencies(low(_words(_docs(s, d)))), keyness.frequencies(low(_words(table(s, d, "benchmark"))))


def _titles(s, d):
    """Documents as records: title is the first line's first 40 characters."""
    return _titled_docs(_docs(s, d))


def _titled_docs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").alias("language"), "source", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 40).alias("title"), "text", "n_chars")


TITLES = "SELECT doc_id, lang AS language, source, substring(split_part(text, chr(10), 1), 1, 40) AS title, text, n_chars FROM documents"


def _atoms(s, d):
    return _docs(s, d).select(F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en").alias("language"), F.floor(F.col("doc_id") / 8).alias("cluster_id"), F.element_at(F.array(*map(F.lit, ("msd", "gesund", "nhs", "apoum"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("source"),
                              F.col("doc_id").cast("string").alias("id"), (2 + F.floor(F.col("doc_id") / 8) % 3).alias("tier"))


ATOMS = "SELECT CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'en' END AS language, doc_id // 8 AS cluster_id, ['msd','gesund','nhs','apoum'][doc_id % 4 + 1] AS source, doc_id::VARCHAR AS id, 2 + (doc_id // 8) % 3 AS tier FROM documents"


def _edges(s, d):
    c = F.col("doc_id")
    label = F.element_at(F.array(*map(F.lit, ("richtig_1", "spezialisierung", "generalisierung", "False"))), (c % 4 + 1).cast("int"))
    return _docs(s, d).select(F.concat(F.lit("n"), (c % 97).cast("string")).alias("a"), F.concat(F.lit("n"), (c * 7 % 89).cast("string")).alias("b"), label.alias("label"), F.when(c % 3 == 0, "human").otherwise("llm").alias("judge"), F.lit("m").alias("model"),
                              F.lit("va").alias("a_view"), F.lit("vb").alias("b_view"))


EDGES = """SELECT 'n' || (doc_id % 97) AS a, 'n' || (doc_id * 7 % 89) AS b, ['richtig_1','spezialisierung','generalisierung','False'][doc_id % 4 + 1] AS label,
CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'llm' END AS judge, 'm' AS model, 'va' AS a_view, 'vb' AS b_view FROM documents"""


def _index(s, d):
    """Record ids of four vocabularies, from a document's number."""
    c, v = F.col("doc_id"), ("ICD-10CM", "MeSH", "DOID", "Pschyrembel")
    ids = [F.struct(F.lit(x).alias("vocab"), F.floor(c / (3 + i)).cast("string").alias("value")) for i, x in enumerate(v)]
    return _docs(s, d).select(F.explode(F.array(*ids)).alias("x"), "source", c.cast("string").alias("instance")).select("x.*", "source", "instance")


def _records(s, d):
    """Records with a map from vocabulary to lists of (value, distance), one vocabulary unknown."""
    c, v = F.col("doc_id"), ("ICD-10CM", "MeSH", "DOID", "Pschyrembel")
    one = lambda x: F.array(F.struct(x.alias("value"), F.lit(0.0).alias("distance")))
    ids = F.create_map(*[y for i, x in enumerate(v) for y in (F.lit(x), one(F.floor(c / (3 + i)).cast("string")))], F.lit("other"), one(c.cast("string")))
    return _docs(s, d).select("source", c.cast("string").alias("instance"), ids.alias("external_ids"))


INDEX = "SELECT v AS vocab, (doc_id // k)::VARCHAR AS value, source, doc_id::VARCHAR AS instance FROM documents, (VALUES ('ICD-10CM', 3), ('MeSH', 4), ('DOID', 5), ('Pschyrembel', 6)) t(v, k)"


def _cells(s, d):
    """Paired values of orders' lines: group and difference."""
    li = table(s, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("step"), (F.col("l_quantity") - 25).alias("delta"), (F.col("l_quantity") / 2 - 12).alias("d_simp"), (F.col("l_quantity") - 25.0).alias("d_orig"), F.col("l_extendedprice").alias("value"))


CELLS = "SELECT l_returnflag AS metric, l_linestatus AS step, l_quantity - 25 AS delta, l_quantity / 2 - 12 AS d_simp, l_quantity - 25.0 AS d_orig, l_extendedprice AS value FROM lineitem"


def _rows(s, d):
    return _titled_docs(_docs(s, d)).withColumnRenamed("doc_id", "rowid")


def _asked(rows):
    """The phrases of every twentieth title."""
    return _title_queries(rows.where(F.col("rowid") % 20 == 0)).select("query_id", F.posexplode(F.array_distinct("phrases")).alias("phrase_id", "phrase"))


def _phrase_search(s, d):
    """The titles of every twentieth document, as phrases, in all texts: the ten best of each."""
    rows = _rows(s, d)
    found = index.build(rows).bm25(_asked(rows).withColumn("col", F.lit("text")), 10)
    return rounded(found).select("query_id", "rowid", "rank")


def _phrase_top(s, d):
    """The same queries in all titles."""
    rows = _rows(s, d)
    return rounded(index.build(rows, ("title",)).bm25(_asked(rows), 10)).select("query_id", "rowid", "rank")


def _keyword_top(s, d):
    """The words of every twentieth title, each by itself, in all texts: the ten best of each, pruned by block."""
    rows = _rows(s, d)
    q = rows.where(F.col("rowid") % 20 == 0).select(F.col("rowid").alias("query_id"), F.explode(index.words("title")).alias("term"), F.lit("text").alias("col"))
    return rounded(index.build(rows).best(q, 10)).select("query_id", "rowid", "rank")


def _look(column: str, k: int, length: str | None = None, each: bool = False) -> str:
    """CTEs of the search for every twentieth title: ``top`` (query_id, rowid, rank, rn). Lengths count both columns."""
    size = f"len(regexp_extract_all(lower(coalesce({length or 'title'}, '')), {WORDS}))" + ("" if length else f" + len(regexp_extract_all(lower(coalesce(text, '')), {WORDS}))")
    parts = f"""list_filter(list_transform(list_filter(list_transform(string_split(translate(lower(title), '"()', ''), ','), lambda p: trim(p)), lambda p: p <> ''), lambda p: regexp_extract_all(p, {WORDS})), lambda p: len(p) > 0)"""
    phrases = f"list_transform(regexp_extract_all(lower(title), {WORDS}), lambda w: [w])" if each else parts
    return rf"""ti AS ({TITLES}), rw AS (SELECT doc_id AS rowid, regexp_extract_all(lower({column}), {WORDS}) AS w, {size} AS dl FROM ti), st AS (SELECT count(*) AS n, avg(dl) AS a FROM rw WHERE dl > 0),
qs AS (SELECT doc_id AS query_id, list_distinct({phrases}) AS ps FROM ti WHERE doc_id % 20 = 0),
qp AS (SELECT query_id, unnest(ps) AS phrase FROM qs), sz AS (SELECT DISTINCT len(phrase) AS m FROM qp), pd AS (SELECT DISTINCT phrase FROM qp),
gr AS (SELECT rowid, dl, w, m, unnest(range(len(w) - m + 1)) AS i FROM rw, sz WHERE len(w) >= m), hp AS (SELECT rowid, dl, list_slice(w, i + 1, i + m) AS phrase FROM gr),
ht AS (SELECT phrase, rowid, dl, count(*) AS tf FROM hp SEMI JOIN pd USING (phrase) GROUP BY ALL), df AS (SELECT phrase, count(*) AS k FROM ht GROUP BY phrase),
sc AS (SELECT query_id, rowid, -sum(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS rank FROM qp JOIN ht USING (phrase) JOIN df USING (phrase), st GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), rowid) AS rn FROM sc) WHERE rn <= {k})"""


def _knn(metric):
    def run(s, d):
        e = table(s, d, "embeddings")
        q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        return rounded(search.nearest(q, e.select(F.col("vec_id").alias("rowid"), "embedding"), 5, metric).drop("rn"))
    return run


def _knn_sql(expr):
    return f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS rowid, {expr} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, rowid, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rowid) AS rn FROM p) WHERE rn <= 5"""


_VA, _VB = "a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]"


def _smoothed(s, d):
    return keyness.compare(*_freqs(s, d))


KEY = rf"""st AS (SELECT lower(t) AS token, count(*) AS study_freq FROM (SELECT unnest(regexp_extract_all(text, {WORDS})) AS t FROM documents) GROUP BY 1),
rf AS (SELECT lower(t) AS token, count(*) AS ref_freq FROM (SELECT unnest(regexp_extract_all(text, {WORDS})) AS t FROM benchmark) GROUP BY 1),
ts AS (SELECT sum(study_freq)::DOUBLE AS sn, count(*) AS sk FROM st), tr AS (SELECT sum(ref_freq)::DOUBLE AS rn, count(*) AS rk FROM rf),
j AS (SELECT coalesce(st.token, rf.token) AS token, coalesce(study_freq, 0) AS study_freq, coalesce(ref_freq, 0) AS ref_freq FROM st FULL JOIN rf ON st.token = rf.token),
ab AS (SELECT *, study_freq / sn AS study_rel_freq, ref_freq / rn AS ref_rel_freq, study_freq + 0.1::DOUBLE AS a, ref_freq + 0.1::DOUBLE AS b, sn - study_freq + 0.1::DOUBLE * sk AS c, rn - ref_freq + 0.1::DOUBLE * rk AS d FROM j, ts, tr),
ke AS (SELECT *, CASE WHEN a / (a + c) < b / (b + d) THEN -1 ELSE 1 END * 2 * (a * ln(a / ((a + c) * (a + b) / (a + b + c + d))) + b * ln(b / ((b + d) * (a + b) / (a + b + c + d)))) AS ll,
  a * d / (b * c) AS "or", 100 * (a / (a + c) - b / (b + d)) / (b / (b + d)) AS pd FROM ab)"""

# Either comparison holds every token of both corpora, so the outer and the inner merge have the same rows.
MERGE = f"""WITH {KEY} SELECT token, study_freq AS "abs-freq_d", ref_freq AS "abs-freq_b", round(ll, 6) AS "d-v-b_ll", round(b * c / (a * d), 6) AS "b-v-d_or" FROM ke"""


def _jargon_table(s, d):
    return _smoothed(s, d)


def _counted_words(df: DataFrame, *keep: str) -> DataFrame:
    """Lower-case words of texts with their number in each."""
    counts = annotate.word_counts(df, F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower), *keep)
    if df.groupBy(keep[0]).agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return counts
    return counts.groupBy(*keep, "lemma").agg(F.sum("n").alias("n"))  # texts that share a key


def _doc_words(s, d):
    return _words(_docs(s, d), "doc_id").withColumn("lemma", F.lower("lemma"))


DOC_WORDS = rf"dw AS (SELECT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, {WORDS})) AS t FROM documents))"


def _freq_table(s, d):
    f = staged(keyness.frequencies(annotate.tokens(_docs(s, d)).where("is_word")))  # counts shrink within tasks, so no text is dealt out
    return f.join(F.broadcast(f.agg(F.sum("freq").cast("double").alias("t")))).select("token", (F.col("freq") / F.col("t")).alias("rel"))  # one row


def _measures(s, d):
    tok = _tok(s, d, "lang")
    return rounded(metrics.basic(tok))


_W = "count(*) FILTER (is_word)"
MEASURES = rf"""WITH {TOKL}, m AS (SELECT doc_id, {_W} AS n, {_W}::DOUBLE / nullif(count(DISTINCT sent_id) FILTER (is_word), 0) AS sl, avg(syllables) FILTER (is_word) AS sy,
 count(*) FILTER (is_word AND syllables >= 3)::DOUBLE / nullif({_W}, 0) AS ms, count(*) FILTER (is_word AND syllables = 1)::DOUBLE / nullif({_W}, 0) AS es, count(*) FILTER (is_word AND length(text) > 6)::DOUBLE / nullif({_W}, 0) AS iw,
 count(*) FILTER (is_word AND pos = 'NOUN')::DOUBLE / nullif({_W}, 0) AS no, count(*) FILTER (is_word AND pos = 'ADJ')::DOUBLE / nullif({_W}, 0) AS aj, count(*) FILTER (is_word AND pos IN ('VERB', 'AUX'))::DOUBLE / nullif({_W}, 0) AS ve,
 count(*) FILTER (is_word AND NOT CASE WHEN lang = 'en' THEN pos IN ('AUX', 'DET', 'ADP', 'CCONJ', 'SCONJ', 'PART', 'PRON') ELSE pos IN ('AUX', 'DET', 'ADP') END)::DOUBLE / nullif({_W}, 0) AS fu, count(*) FILTER (is_word AND pos = 'NUM')::DOUBLE / nullif({_W}, 0) AS nu,
 count(*) FILTER (is_word AND ((lang = 'de' AND lemma IN ('nicht', 'kein', 'nie', 'nein', 'keineswegs', 'keinesfalls', 'nichts', 'nirgends', 'nimmer', 'niemand', 'nirgendwo', 'niemals')) OR (lang = 'en' AND lemma IN ('not', 'no', 'never', 'neither', 'nor', 'nobody', 'nothing', 'nowhere', 'none'))))::DOUBLE / nullif({_W}, 0) AS ng,
 count(DISTINCT lemma) FILTER (is_word)::DOUBLE / nullif({_W}, 0) AS tt, count(DISTINCT lemma) FILTER (is_alpha AND NOT is_stop) AS v, count(*) FILTER (is_alpha AND NOT is_stop) AS tl, count(*) FILTER (is_alpha) AS ta, count(DISTINCT sent_id) AS ns FROM tok GROUP BY doc_id)
SELECT doc_id, round(sl, 6) AS avg_sentence_length, round(sy, 6) AS avg_syllable_length, round(no, 6) AS noun_ratio, round(aj, 6) AS adjective_ratio, round(ve, 6) AS verb_ratio, round(fu, 6) AS function_word_ratio, round(nu, 6) AS numbers_ratio, round(ng, 6) AS negations_ratio,
 round(tt, 6) AS type_token_ratio, tl AS text_length_lex, ta AS text_length, ns AS text_length_sentences, n AS n_words, round(0.39 * sl + 11.8 * sy - 15.59, 6) AS fkgl,
 round(0.1935 * 100 * ms + 0.1672 * sl + 0.1297 * 100 * iw - 0.0327 * 100 * es - 0.875, 6) AS wstf, round(CASE WHEN tl = 1 THEN 0.0 WHEN tl > 1 THEN ln(v) / ln(tl) END, 6) AS herdans_c FROM m"""
_SEQ = "row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, tok_i)"


def _heaps_sql(test, least, tail, name):
    return rf"""WITH {TOK}, s AS (SELECT doc_id, lemma, {_SEQ} AS i FROM tok WHERE {test}),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, lemma ORDER BY i) = 1 THEN 1 ELSE 0 END AS f, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
v AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM f WHERE n >= {least}),
p AS (SELECT doc_id, ln(i) AS x, ln(v) AS y, i::DOUBLE * i AS w FROM v WHERE i % greatest(1, n // 600) = 0 AND i >= {tail})
SELECT doc_id, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / nullif(sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x), 0), 4) AS {name} FROM p GROUP BY doc_id HAVING count(*) >= 2"""


def _text_functions(s, d):
    t = F.col("text")
    df = _docs(s, d).withColumn("md", F.concat(F.lit("| a | b |\n|---|---|\n"), t))
    return df.select("doc_id", F.md5(T.normalize_newlines(t).cast("binary")).alias("newlines"), F.md5(T.collapse_newlines(F.replace(t, F.lit("\n"), F.lit("\n\n\n"))).cast("binary")).alias("collapsed"), F.md5(T.edit_md_tables(F.col("md")).cast("binary")).alias("tables"),
                     T.word_count(t).cast("long").alias("n_words"), F.array_join(T.split_ids(F.concat(F.col("source"), F.lit("; "), F.col("lang"), F.lit(";; "), F.col("doc_id").cast("string"))), "|").alias("ids"), T.short_id(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit("_de"))).alias("short"),
                     T.after_thinking(F.concat(F.lit("<think>x</think> "), F.col("source"))).alias("answer"), T.parse_verdict(F.concat(F.lit("<think>falsch</think>Ist "), F.element_at(F.array(*map(F.lit, ("Richtig", "eine Spezialisierung", "falsch", "unklar"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" "))).alias("verdict"), T.sig_marker(F.col("n_chars") / 10000.0).alias("marker"),
                     T.format_query(F.concat(F.col("source"), F.lit(", x"))).alias("query"), F.to_json(T.highlight_offsets(F.concat(F.lit("a <b>bc</b> d <b>"), F.col("source"), F.lit("</b>")))).alias("offsets"), T.plot_title(F.concat(F.col("source"), F.lit("--"), F.col("lang"), F.lit(" \\%"))).alias("title"),
                     T.render_prompt("Say: {TEXT}!", F.col("source")).alias("prompt"), T.strip_bracket(F.concat(F.col("source"), F.lit(" [x]"))).alias("bare"))


TEXT_FUNCTIONS = r"""SELECT doc_id, md5(regexp_replace(trim(text), '\n+', chr(10) || chr(10), 'g')) AS newlines, md5(regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\n\n+', chr(10) || chr(10), 'g')) AS collapsed,
md5(regexp_replace(regexp_replace('| a | b |' || chr(10) || '|---|---|' || chr(10) || text, '(\| *-+ *)+\| *\n', chr(10), 'g'), ' *\| *', chr(10), 'g')) AS tables, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
source || '|' || lang || '|' || doc_id AS ids, doc_id::VARCHAR AS short, source AS answer, ['richtig', 'spezialisierung', 'falsch', 'ist unklar'][doc_id % 4 + 1] AS verdict, CASE WHEN n_chars / 10000.0 < 0.001 THEN '***' WHEN n_chars / 10000.0 < 0.01 THEN '**' WHEN n_chars / 10000.0 < 0.05 THEN '*' ELSE 'ns' END AS marker,
'("' || source || '" OR "x")' AS query, '[{"s":2,"e":4},{"s":7,"e":' || (7 + length(source)) || '}]' AS offsets, source || '–' || lang || ' %' AS title, 'Say: ' || source || '!' AS prompt, source AS bare FROM documents"""


def _members(s, d):
    return _docs(s, d).select("source", F.col("doc_id").cast("string").alias("id"), F.element_at(F.array(*map(F.lit, ("4_tier", "3_tier", "2_tier", "unaligned"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("bucket"))


def _instances(s, d):
    corp = _docs(s, d).select("source", F.col("doc_id").cast("string").alias("id"), T.word_count(F.col("text")).alias("n_words"))
    return linkage.stratified(linkage.best_bucket(_members(s, d), corp, ["4_tier", "3_tier", "2_tier", "unaligned"], 1000)).select("source", "id", "priority", "bucket", "turn")


def _gold(s, d):
    lab = table(s, d, "labels")
    return lab.select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))


def _signed(s, d):
    """Ties as whole numbers of 64 bits, as the SQL has them; more of them are an error in both."""
    return rounded(stats.signed_ranks(_cells(s, d), ["metric", "step"]).drop("ranks2").withColumn("ties", F.col("ties").cast("bigint")))



# The upper tail of the normal law by its series, for tests of groups of more than 50 values.
TAIL = "(0.5 - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(abs({z}) + 1e-300) - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1)))))"
# P(W+ >= w) over all sign patterns: the number of patterns for each sum of doubled ranks, built up rank by rank.
PATTERNS = ("list_sum(list_slice(list_reduce(list_concat([list_concat([1.0::DOUBLE], list_transform(range(list_sum(r2)::BIGINT), lambda i: 0.0::DOUBLE))], list_transform(r2, lambda x: [x])), "
            "lambda acc, x: list_transform(range(1, list_sum(r2)::BIGINT + 2), lambda i: acc[i] + CASE WHEN i - x[1] >= 1 THEN acc[(i - x[1])::BIGINT] ELSE 0 END)), ceil(2 * {w})::BIGINT + 1, 1000000)) / pow(2, len(r2))")
SIGNED = f"""c AS ({CELLS}), md AS (SELECT metric, step, count(*) AS n_all, median(delta) AS median_delta FROM c GROUP BY ALL),
t AS (SELECT metric, step, abs(delta) AS m, count(*) AS t, count(*) FILTER (delta > 0) AS pos FROM c WHERE delta <> 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY metric, step ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM t),
a AS (SELECT metric, step, sum(t)::BIGINT AS n, sum(rank * pos) AS w_plus, sum(rank * (t - pos)) AS w_minus, sum(t::HUGEINT * t * t - t)::BIGINT AS ties, sum(pos)::BIGINT AS n_pos FROM r GROUP BY ALL),
r2 AS (SELECT metric, step, flatten(list(list_transform(range(t), lambda i: (2 * rank)::DOUBLE))) AS r2 FROM r GROUP BY ALL),
z AS (SELECT *, (w_plus - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48.0) AS z FROM a)
SELECT metric, step, n_all, round(median_delta, 6) AS median_delta, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, ties, n_pos, round(z, 6) AS z, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial, round(n_pos::DOUBLE / n, 6) AS pct_positive FROM md JOIN z USING (metric, step)"""


def _tests(s, d):
    """p-values as data: a family per market segment."""
    c = table(s, d, "customer")
    return c.select(F.col("c_mktsegment").alias("metric"), F.col("c_custkey").alias("step"), ((F.col("c_custkey") * 37 % 1009) / 200000.0).alias("p"))


TESTS = "SELECT c_mktsegment AS metric, c_custkey AS step, (c_custkey * 37 % 1009) / 200000.0 AS p FROM customer"


def _rejected(how):
    return lambda s, d: stats.rejected(_tests(s, d), ["metric"], how).select("metric", "step", "reject")


def _steps(s, d):
    """Steps of metrics, some without an expectation, a shift or a p-value."""
    k = F.col("c_custkey")
    shift = F.when(k % 97 == 0, F.lit(None).cast("double")).when(k % 11 == 0, -1.0).when(k % 13 == 0, 0.0).otherwise(1.0)
    return table(s, d, "customer").select((k % 400).alias("metric"), (F.lit(1) - k % 400 % 3).cast("int").alias("expected"), shift.alias("shift"),
                                          F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise((k * 7 % 101) / 100.0).alias("p"))


_VERDICT = """WITH s AS (SELECT c_custkey % 400 AS metric, 1 - c_custkey % 400 % 3 AS e, CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN -1 WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS shift,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey * 7 % 101) / 100.0::DOUBLE END AS p FROM customer),
r AS (SELECT *, coalesce(shift * e > 0, false) AS ok FROM s),
c AS (SELECT metric, any_value(e) AS e, count(*) AS k, count(*) FILTER (shift IS NULL) AS miss, count(*) FILTER (NOT ok AND {p} < 0.05::DOUBLE) AS ws, count(*) FILTER (NOT ok) AS w, count(*) FILTER (ok AND p < 0.05::DOUBLE) AS rs FROM r GROUP BY metric)
SELECT metric, CASE WHEN miss > 0 THEN 'missing data' WHEN e = 0 THEN '(no expectation)' WHEN ws > 0 THEN 'WRONG DIRECTION (' || ws || '/' || k || ' sig.)' WHEN w > 0 THEN 'NEAR-MONO (flip ns; ' || rs || '/' || k || ' right-sig.)'
 WHEN rs = k THEN 'PASS (monotonic, all sig.)' ELSE 'monotonic, ' || rs || '/' || k || ' sig.' END AS verdict FROM c"""


def _bigram(s, d):
    return rounded(language_model.perplexities(gram_blocks.bigram_loss(_docs(s, d))), 4)


BIGRAM = f"""WITH {TOK}, b AS (SELECT doc_id, sent_id, lemma, coalesce(lag(lemma) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_i), '<s>') AS before FROM tok),
two AS (SELECT before, lemma, count(*) AS c2 FROM b GROUP BY ALL), one AS (SELECT before, sum(c2) AS c1 FROM two GROUP BY before), v AS (SELECT count(DISTINCT lemma) AS v FROM tok),
l AS (SELECT doc_id, sent_id, count(*) AS n, avg(-ln((c2 + 0.1::DOUBLE) / (c1 + 0.1::DOUBLE * v))) AS loss FROM b JOIN two USING (before, lemma) JOIN one USING (before), v GROUP BY doc_id, sent_id)
SELECT doc_id, round(avg(exp(loss)) FILTER (n >= 3), 4) AS appl_filtered_mean, round(median(exp(loss)) FILTER (n >= 3), 4) AS appl_filtered_median, round(avg(exp(loss)), 4) AS appl_full_mean, round(median(exp(loss)), 4) AS appl_full_median,
round(exp(sum(loss * n) / sum(n)), 4) AS appl_fulltext FROM l GROUP BY doc_id"""


def _mask(s, d):
    return rounded(language_model.masked_rank(annotate.sentence_words(_docs(s, d)), language_model.unigram_ranks(annotate.tokens(_docs(s, d)))))


def _hits(s, d):
    """Hits of the titles of every twentieth document among all titles."""
    rows = _titles(s, d).withColumnRenamed("doc_id", "rowid")
    return search.lookup_hits(rows, _title_queries(rows.where(F.col("rowid") % 20 == 0))), rows.select("rowid", "source", "language")


_PAIR = f"""pr AS (SELECT language, a.source AS source_a, a.id AS id_a, b.source AS source_b, b.id AS id_b, array_to_string(list_sort(list(DISTINCT cluster_id)), ',') AS cluster_ids, max(a.tier) AS max_tier
FROM ats a JOIN ats b USING (language, cluster_id) WHERE (a.source, a.id) < (b.source, b.id) GROUP BY ALL)"""


def _pairs(s, d):
    return linkage.cluster_pairs(_atoms(s, d))


def _titled(s, d):
    t = _docs(s, d).select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 12).alias("t"))
    return _pairs(s, d).join(t.withColumnsRenamed({"id": "id_a", "t": "title_a"}), "id_a").join(t.withColumnsRenamed({"id": "id_b", "t": "title_b"}), "id_b")


_TITLED = "tp AS (SELECT pr.*, substring(x.text, 1, 12) AS title_a, substring(y.text, 1, 12) AS title_b FROM pr JOIN documents x ON x.doc_id::VARCHAR = id_a JOIN documents y ON y.doc_id::VARCHAR = id_b)"


def _gold_titles(s, d):
    return _titled(s, d).where(F.col("id_a").cast("long") % 5 == 0).select("title_a", "title_b")


def queries() -> dict:
    q = {
        "document_measures": _measures,
        "sentence_split": lambda s, d: annotate.sentences(_docs(s, d)).select("doc_id", "sent_id", F.md5(F.col("sentence").cast("binary")).alias("sentence")),
        "token_table": lambda s, d: _tok(s, d).groupBy("pos", "is_word", "is_alpha", "is_stop").agg(F.count("*").alias("n"), F.sum("syllables").alias("syllables"), F.countDistinct("lemma").alias("types")),
        "syntax_measures": lambda s, d: rounded(metrics.syntax(_tok(s, d))),
        "moving_ttr": lambda s, d: rounded(metrics.mattr(_tok(s, d))),
        "heaps_beta": lambda s, d: rounded(metrics.heaps_law_beta(_tok(s, d)), 4),
        "heaps_beta_lex": lambda s, d: rounded(metrics.heaps_law_beta_lex(_tok(s, d)), 4),
        "lexical_chains": lambda s, d: rounded(metrics.chains(_tok(s, d))),
        "word_frequency": lambda s, d: rounded(metrics.word_freq(_tok(s, d), _freq_table(s, d)), 8),
        "noun_phrases": lambda s, d: rounded(metrics.noun_phrases(_tok(s, d))),
        "tree_depth": lambda s, d: rounded(metrics.tree_depth(_sents(s, d))),
        "subword_measures": lambda s, d: rounded(vocabulary.subword_metrics(annotate.sentences(_spread(_docs(s, d))), _tok(s, d), _docs(s, d))),
        "text_functions": _text_functions,
        "markdown_plain": lambda s, d: _docs(s, d).select("doc_id", T.preprocess(F.col("text"), "strip", True).alias("plain")),
        "normal_titles": lambda s, d: _titles(s, d).select("doc_id", T.clean_query(F.col("title")).alias("query")),
        "html_plain": lambda s, d: corpus.html_pages(table(s, d, "pages")),
        "token_frequencies": lambda s, d: keyness.frequencies(_words(_docs(s, d))),
        "token_frequencies_lower": lambda s, d: keyness.transformed(keyness.frequencies(_words(_docs(s, d)))),
        "corpus_stats": lambda s, d: keyness.corpus_stats(_freqs(s, d)[0]),
        "keyness_full": lambda s, d: rounded(_smoothed(s, d)).select("token", "study_freq", "ref_freq", "study_rel_freq", "ref_rel_freq", "ll", "or", "pd"),
        "keyness_bayes_g": lambda s, d: rounded(keyness.compare(*_freqs(s, d), metrics=("bf", "g"))).select("token", "bf", "g"),
        "keyness_unknown": lambda s, d: rounded(keyness.unknown_mass(*_freqs(s, d))),
        "keyness_merge_outer": lambda s, d: rounded(_merge(s, d, "outer")), "keyness_merge_inner": lambda s, d: rounded(_merge(s, d, "inner")),
        "jargon_density": lambda s, d: keyness.jargon_density(_doc_words(s, d), _jargon_table(s, d)),
        "jargon_terms": lambda s, d: rounded(keyness.jargon_only(_doc_words(s, d), _jargon_table(s, d))).select("doc_id", "token", "freq_in_text", "score"),
        "phrase_search": _phrase_search, "phrase_top": _phrase_top, "keyword_top": _keyword_top,
        "title_lookup": lambda s, d: search.lookup_titles(*_hits(s, d), ["source", "language"]).select("query_id", F.array_join("source", ",").alias("sources"), F.array_join("language", ",").alias("languages")),
        "knn_l2": _knn("l2"), "knn_l1": _knn("l1"), "knn_cosine": _knn("cosine"),
        "knn_by_label": _knn_label, "min_distance": lambda s, d: rounded(search.min_distance(_near(s, d), "label")),
        "reverse_search": _reverse,
        "metadata_filter": lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("meta")).where(search.metadata_filter(F.col("meta"), event_type=["click", "view", "purchase"])).select("event_id"),
        "synonym_rows": lambda s, d: linkage.flattened_synonyms(_titles(s, d).withColumn("syn", F.concat_ws(";", "language", "source", "title")), "doc_id", "title", "syn"),
        "descriptor_sets": lambda s, d: linkage.joined_sets(_titles(s, d), "source", ["language"]),
        "reverse_index": lambda s, d: linkage.reverse_index(_records(s, d)),
        "two_hop_expansion": lambda s, d: linkage.expand_two_hops(_index(s, d)),
        "instance_expansion": lambda s, d: linkage.expand_by_instance(_index(s, d)),
        "merge_down": lambda s, d: linkage.merged_down(_index(s, d).select("vocab", "value", "source", "instance"), ["vocab", "value"]),
        "cluster_tiers": lambda s, d: linkage.tiers(_atoms(s, d)), "bilingual_clusters": lambda s, d: linkage.bilingual(_bi(s, d)),
        "cluster_pairs": _pairs,
        "pair_duplicates": lambda s, d: linkage.duplicate_pairs(_titled(s, d).select("title_a", "title_b"), 5),
        "pairs_filtered": lambda s, d: linkage.filtered_pairs(_titled(s, d), _gold_titles(s, d)).select("language", "id_a", "id_b"),
        "pairs_bilingual": lambda s, d: linkage.bilingual_id_pairs(_pairs(s, d).unionByName(_pairs(s, d).withColumn("language", F.lit("xx")))),
        "confusion": lambda s, d: rounded(linkage.confusion(_gold(s, d))),
        "article_titles": lambda s, d: linkage.article_titles(_views(s, d), ["professional", "amateur", "short"]),
        "site_pairs": lambda s, d: linkage.site_pairs(_views(s, d)),
        "title_expansion": lambda s, d: linkage.node_pairs(_titled(s, d).select("title_a", "title_b"), _nodes(s, d)),
        "unresolved_titles": _unresolved,
        "canonical_edges": lambda s, d: linkage.canonical(_edges(s, d)), "edge_counts": lambda s, d: linkage.canonical(_edges(s, d), True).rollup("judge", "label").agg(F.count("*").alias("n")),
        "partner_tiers": lambda s, d: linkage.partner_tiers(_edges(s, d), _membership(s, d)),
        "rule_judge": lambda s, d: linkage.rule_judge(_titled(s, d)).select("language", "id_a", "id_b", "pred"),
        "best_instances": _instances, "resume_rest": lambda s, d: linkage.remaining(_docs(s, d).select("doc_id"), table(s, d, "labels"), ["doc_id"]),
        "adjacent_steps": lambda s, d: stats.adjacent_steps(_chain(s, d)),
        "oriented_deltas": lambda s, d: rounded(_delta(s, d)),
        "signed_ranks": _signed, "signed_rank_p": lambda s, d: rounded(stats.with_p(stats.signed_ranks(_cells(s, d), ["metric", "step"])).select("metric", "step", "p")),
        "reject_holm": _rejected("holm"), "reject_bonferroni": _rejected("bonferroni"), "reject_none": _rejected("none"),
        "verdicts": lambda s, d: stats.grade(_steps(s, d), ["metric"]), "verdicts_two_sided": lambda s, d: stats.grade(_steps(s, d), ["metric"], one_sided=False),
        "bleed_through": lambda s, d: rounded(stats.bleed_through(_cells(s, d), ["metric"])),
        "mean_sd": lambda s, d: rounded(stats.mean_sd(_cells(s, d), ["metric", "step"])), "tier_medians": lambda s, d: rounded(stats.medians(_cells(s, d), ["metric"], 0.5)),
        "box_summary": lambda s, d: rounded(stats.box_summary(_cells(s, d), ["metric", "step"])),
        "value_cleaning": lambda s, d: stats.clean_values(_docs(s, d).select((F.col("doc_id") % 50).alias("id"), F.when(F.col("doc_id") % 3 == 0, "-1").when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("n_chars").cast("string")).alias("v"), "doc_id"), "v", "id", "doc_id"),
        "bigram_perplexity": _bigram, "adjacent_overlap": lambda s, d: rounded(language_model.adjacent_overlap(_tok(s, d))), "masked_rank": _mask,
        "simplify_rule": lambda s, d: language_model.simplify(_docs(s, d)).select("doc_id", F.md5(F.col("simplified_text").cast("binary")).alias("text")),
        "split_registry": lambda s, d: corpus.splits(s, language="de").select("source", "subtree", "language"),
    }
    return q


def _merge(s, d, how):
    st, rf = _freqs(s, d)
    one = keyness.compare(st, rf, ("ll",)).select("token", "study_freq", "ref_freq", "ll")
    two = keyness.compare(rf, st, ("or",)).select("token", "study_freq", "ref_freq", "or")
    return keyness.merged({"d-v-b": one, "b-v-d": two}, how)


def _near(s, d):
    e = table(s, d, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest(q, e.select(F.col("vec_id").alias("rowid"), "embedding"), 5).join(e.select(F.col("vec_id").alias("rowid"), "label"), "rowid")


def _knn_label(s, d):
    e = table(s, d, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return rounded(search.nearest(q, e.select(F.col("vec_id").alias("rowid"), "embedding", "label"), 3, on=["label"]).drop("rn"))


def _title_queries(records: DataFrame) -> DataFrame:
    """The search for each record's title: any of its parts between commas, without regard to case.

    Accents stay composed, as in the titles that are searched.
    """
    return records.select(F.col("rowid").alias("query_id"), T.query_phrases(F.translate(F.lower("title"), '"()', "")).alias("phrases"))


def _reverse(s, d):
    """Vectors are those of the documents of the same number; neighbours' titles are looked up among all documents."""
    n, rows = staged(_near(s, d)), _titles(s, d).withColumnRenamed("doc_id", "rowid")
    found = search.lookup_hits(rows, _title_queries(rows.join(n.select("rowid").distinct(), "rowid", "left_semi")))
    return rounded(search.reverse_checked(n, found.select(F.col("query_id").alias("rowid"), F.col("rowid").alias("query_id"))))


def _unresolved(s, d):
    """Unresolved titles of each side of the pairs; a side without any has a row too."""
    left = linkage.unresolved(_titled(s, d).select("title_a", "title_b", F.lit("x").alias("label")), _nodes(s, d))
    sides = s.createDataFrame([("a",), ("b",)], "side string")
    return sides.join(left.groupBy("side").agg(F.count("*").alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


def _bi(s, d):
    return _atoms(s, d).select("cluster_id").distinct().select(F.explode(F.array(F.struct(F.lit("de").alias("language"), (2 + F.col("cluster_id") % 3).alias("tier")), F.struct(F.lit("en").alias("language"), (2 + F.col("cluster_id") % 2).alias("tier")))).alias("x"), "cluster_id").select("x.*", "cluster_id")


def _views(s, d):
    sub = F.element_at(F.array(*map(F.lit, ("professional", "amateur", "short"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return _titles(s, d).select("source", F.floor(F.col("doc_id") / 60).cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en").alias("language"), sub.alias("subtree"), "title", "text")


VIEWS = f"SELECT source, (doc_id // 60)::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'en' END AS language, ['professional','amateur','short'][doc_id % 3 + 1] AS subtree, title, text FROM ({TITLES})"


def _nodes(s, d):
    return _docs(s, d).select(F.substring("text", 1, 12).alias("title"), F.col("doc_id").cast("string").alias("node"))


def _membership(s, d):
    return _docs(s, d).select(F.concat(F.lit("n"), (F.col("doc_id") % 97).cast("string")).alias("node"), (F.col("doc_id") % 97 % 4).alias("tier"))


def _chain(s, d):
    return table(s, d, "nation").select(F.col("n_regionkey").alias("language"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("source"))


def _delta(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    e = table(s, d, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.col("o_orderpriority").alias("source_a"), F.col("o_orderstatus").alias("source_b"))
    steps = table(s, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("next")).distinct()
    return stats.deltas(stats.oriented_pairs(e, steps), o)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    pair = f"WITH ats AS ({ATOMS}), {_PAIR}"
    titled = f"{pair}, {_TITLED}"
    return {
        "document_measures": MEASURES,
        "sentence_split": f"WITH {TOK} SELECT doc_id, sent_id, md5(sentence) AS sentence FROM sx",
        "token_table": f"WITH {TOK} SELECT pos, is_word, is_alpha, is_stop, count(*) AS n, sum(syllables)::BIGINT AS syllables, count(DISTINCT lemma) AS types FROM tok GROUP BY ALL",
        "moving_ttr": f"""WITH {TOK}, s AS (SELECT doc_id, lemma, {_SEQ} AS i FROM tok WHERE is_word), p AS (SELECT *, lag(i) OVER (PARTITION BY doc_id, lemma ORDER BY i) AS pv, count(*) OVER (PARTITION BY doc_id) AS n FROM s)
SELECT doc_id, round(CASE WHEN max(n) <= 100 THEN count(DISTINCT lemma)::DOUBLE / max(n) ELSE sum(greatest(0, least(i, n - 99) - greatest(coalesce(pv, 0), i - 100, 0)))::DOUBLE / (max(n) - 99) / 100 END, 6) AS mattr FROM p GROUP BY doc_id""",
        "heaps_beta": _heaps_sql("is_alpha", 500, 400, "heaps_law_beta"), "heaps_beta_lex": _heaps_sql("is_alpha AND NOT is_stop", 200, 100, "heaps_law_beta_lex"),
        "syntax_measures": f"""WITH {TOK}, s AS (SELECT doc_id, sent_id, string_agg(CASE pos {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in metrics.TAG_LETTERS.items())} END, '' ORDER BY tok_i) AS tags FROM tok WHERE is_word GROUP BY ALL),
p AS (SELECT *, lag(tags) OVER (PARTITION BY doc_id ORDER BY sent_id) AS before FROM s)
SELECT doc_id, round(count(DISTINCT tags)::DOUBLE / count(*), 6) AS grammar_frequency, round(avg(levenshtein(tags, before)::DOUBLE / greatest(length(tags), length(before))), 6) AS adjacent_sent_edit_distance FROM p GROUP BY doc_id""",
        "lexical_chains": f"""WITH {TOK}, a AS (SELECT *, {_SEQ} AS ap FROM tok), w AS (SELECT doc_id, count(*) FILTER (is_word) AS n FROM tok GROUP BY doc_id),
c AS (SELECT doc_id, lemma, count(*) AS c, min(ap) AS s, max(ap) AS e FROM a WHERE is_word AND pos = 'NOUN' GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT doc_id, avg(c) AS mean FROM c GROUP BY doc_id), x AS (SELECT a.doc_id, count(*) AS k FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.lemma < b.lemma AND a.s <= b.e AND b.s <= a.e GROUP BY 1)
SELECT w.doc_id, round(mean / nullif(n, 0), 6) AS lexical_chain_lens, round(coalesce(k, 0)::DOUBLE / nullif(n, 0), 6) AS crossing_lexical_chains FROM w LEFT JOIN m USING (doc_id) LEFT JOIN x USING (doc_id)""",
        "word_frequency": f"""WITH {TOK}, f AS (SELECT lemma, count(*)::DOUBLE / (SELECT count(*) FROM tok WHERE is_word) AS rel FROM tok WHERE is_word GROUP BY lemma)
SELECT doc_id, round(avg(coalesce(rel, 0)) FILTER (is_word), 8) AS word_freq, round(avg(coalesce(rel, 0)) FILTER (is_alpha AND NOT is_stop), 8) AS word_freq_filtered FROM tok LEFT JOIN f USING (lemma) GROUP BY doc_id""",
        "noun_phrases": f"""WITH {TOK}, p AS (SELECT *, pos IN ('DET','ADJ','NUM','NOUN') AS part FROM tok), n AS (SELECT *, CASE WHEN part AND NOT coalesce(lag(part) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_i), false) THEN 1 ELSE 0 END AS new FROM p),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_i) AS chunk FROM n), k AS (SELECT doc_id, sent_id, chunk, count(*) FILTER (is_word) AS n FROM c WHERE part GROUP BY ALL HAVING count(*) FILTER (pos = 'NOUN') > 0)
SELECT doc_id, round(avg(n), 6) AS noun_phrase_complexity FROM k GROUP BY doc_id""",
        "tree_depth": f"""WITH RECURSIVE {TOK}, h AS (SELECT doc_id, sent_id, tok_i, is_punct, CASE WHEN tok_i = 0 OR lag(is_punct) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_i) THEN 0 ELSE tok_i - 1 END AS head FROM tok),
r AS (SELECT doc_id, sent_id, tok_i, 0 AS d FROM h WHERE tok_i = 0 UNION ALL SELECT h.doc_id, h.sent_id, h.tok_i, d + 1 FROM r JOIN h ON h.doc_id = r.doc_id AND h.sent_id = r.sent_id AND h.head = r.tok_i AND h.tok_i <> h.head AND NOT h.is_punct)
SELECT doc_id, round(avg(d), 6) AS dep_tree_depth FROM (SELECT doc_id, sent_id, max(d) AS d FROM r GROUP BY ALL) GROUP BY doc_id""",
        "text_functions": TEXT_FUNCTIONS,
        "token_frequencies": f"SELECT t AS token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, {WORDS})) AS t FROM documents) GROUP BY 1",
        "token_frequencies_lower": f"SELECT lower(t) AS token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, {WORDS})) AS t FROM documents) GROUP BY 1",
        "corpus_stats": f"WITH {KEY} SELECT sn::BIGINT AS total, sk AS types FROM ts",
        "keyness_full": f'WITH {KEY} SELECT token, study_freq, ref_freq, round(study_rel_freq, 6) AS study_rel_freq, round(ref_rel_freq, 6) AS ref_rel_freq, round(ll, 6) AS ll, round("or", 6) AS "or", round(pd, 6) AS pd FROM ke',
        "keyness_unknown": f"WITH {KEY} SELECT '<unk>' AS token, coalesce(sum(ref_freq), 0)::BIGINT AS ref_freq, 0.1::DOUBLE AS a, round(sum(ref_freq) + 0.1::DOUBLE, 6) AS b, round(max(sn) + 0.1::DOUBLE * max(sk), 6) AS c, round(max(rn) - sum(ref_freq) + 0.1::DOUBLE * max(rk), 6) AS d FROM j, ts, tr WHERE study_freq = 0",
        "keyness_merge_outer": MERGE, "keyness_merge_inner": MERGE,
        "jargon_density": f"""WITH {KEY}, {DOC_WORDS}, t AS (SELECT doc_id, token, count(*) AS n FROM dw GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS total_tokens, coalesce(sum(n) FILTER ("or" > 20 AND ref_rel_freq <= 0.001::DOUBLE), 0)::BIGINT AS jargon_count, round(100.0 * coalesce(sum(n) FILTER ("or" > 20 AND ref_rel_freq <= 0.001::DOUBLE), 0) / sum(n), 4) AS jargon_per_100 FROM t JOIN ke USING (token) GROUP BY doc_id""",
        "jargon_terms": f"""WITH {KEY}, {DOC_WORDS} SELECT doc_id, token, count(*) AS freq_in_text, round(max("or"), 6) AS score FROM dw JOIN ke USING (token) WHERE "or" > 20 AND ref_rel_freq <= 0.001::DOUBLE GROUP BY doc_id, token""",
        "phrase_search": f"WITH {_look('text', 10)} SELECT query_id, rowid, round(rank, 6) AS rank FROM top",
        "keyword_top": f"WITH {_look('text', 10, each=True)} SELECT query_id, rowid, round(rank, 6) AS rank FROM top",
        "phrase_top": f"WITH {_look('title', 10, 'title')} SELECT query_id, rowid, round(rank, 6) AS rank FROM top",
        "title_lookup": f"""WITH {_look('title', 5)}, j AS (SELECT t.query_id, t.rn, ti.source, ti.language FROM top t JOIN ti ON ti.doc_id = t.rowid)
SELECT query_id, CASE WHEN bool_or(rn = 1 AND source IS NOT NULL) THEN array_to_string(list_sort(list(DISTINCT source) FILTER (source <> '')), ',') END AS sources,
 CASE WHEN bool_or(rn = 1 AND language IS NOT NULL) THEN array_to_string(list_sort(list(DISTINCT language) FILTER (language <> '')), ',') END AS languages FROM j GROUP BY query_id""",
        "knn_l2": _knn_sql(f"sqrt(list_sum(list_transform(list_zip({_VA}, {_VB}), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"), "knn_l1": _knn_sql(f"list_sum(list_transform(list_zip({_VA}, {_VB}), lambda x: abs(x[1] - x[2])))"),
        "knn_cosine": _knn_sql(f"1 - list_cosine_similarity({_VA}, {_VB})"),
        "metadata_filter": "SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'purchase')",
        "synonym_rows": f"""WITH t AS ({TITLES}), y AS (SELECT doc_id, title, 0 AS o FROM t UNION ALL SELECT doc_id, trim(u), 1 FROM (SELECT doc_id, title, unnest(string_split(language || ';' || source || ';' || title, ';')) AS u FROM t) WHERE trim(u) <> '' AND trim(u) <> title)
SELECT doc_id, title, min(o) AS is_synonym FROM y GROUP BY ALL""",
        "descriptor_sets": "SELECT source, string_agg(DISTINCT lang, '; ' ORDER BY lang) AS language FROM documents GROUP BY source",
        "reverse_index": f"SELECT DISTINCT vocab, value, source, instance FROM ({INDEX})",
        "two_hop_expansion": f"""WITH i AS ({INDEX}), one AS (SELECT DISTINCT * FROM i), m AS (SELECT DISTINCT o.vocab AS v0, o.value AS x0, i.vocab, i.value FROM one o JOIN i USING (source, instance))
SELECT vocab, value, source, instance FROM one UNION SELECT v0, x0, source, instance FROM m JOIN i USING (vocab, value)""",
        "instance_expansion": f"WITH i AS ({INDEX}) SELECT DISTINCT a.source, a.instance, b.source AS other_source, b.instance AS other FROM i a JOIN i b USING (vocab, value) WHERE a.source <> b.source",
        "merge_down": f"WITH i AS ({INDEX}) SELECT DISTINCT a.source, a.instance, b.source AS other_source, b.instance AS other FROM i a JOIN i b USING (vocab, value)",
        "cluster_tiers": f"""WITH a AS ({ATOMS}) SELECT language, cluster_id, CASE WHEN any_value(language) = 'de' THEN 2 + max((source = 'gesund')::INT) + max((source = 'apoum')::INT) ELSE 2 + max((source = 'nhs')::INT) END AS tier FROM a GROUP BY language, cluster_id HAVING max((source = 'msd')::INT) = 1""",
        "bilingual_clusters": f"SELECT DISTINCT cluster_id FROM ({ATOMS}) WHERE 2 + cluster_id % 3 = 4 AND 2 + cluster_id % 2 = 3",
        "cluster_pairs": f"{pair} SELECT * FROM pr",
        "pair_duplicates": f"{titled} SELECT least(title_a, title_b) || chr(31) || greatest(title_a, title_b) AS title_pair, count(*) AS n FROM tp GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, 1 LIMIT 5",
        "pairs_bilingual": f"{pair} SELECT source_a, id_a, source_b, id_b, 2::BIGINT AS n_languages FROM pr",
        "pairs_filtered": f"""{titled}, k AS (SELECT *, least(title_a, title_b) AS t1, greatest(title_a, title_b) AS t2 FROM tp),
g AS (SELECT DISTINCT least(trim(title_a), trim(title_b)) AS t1, greatest(trim(title_a), trim(title_b)) AS t2 FROM tp WHERE id_a::BIGINT % 5 = 0),
f AS (SELECT k.* FROM k ANTI JOIN g ON k.t1 = g.t1 AND k.t2 = g.t2), e AS (SELECT * FROM f x WHERE language <> 'en' OR NOT EXISTS (SELECT 1 FROM f y WHERE y.language = 'de' AND y.source_a = x.source_a AND y.id_a = x.id_a AND y.source_b = x.source_b AND y.id_b = x.id_b))
SELECT language, id_a, id_b FROM (SELECT *, row_number() OVER (PARTITION BY t1, t2 ORDER BY language, source_a, id_a, source_b, id_b) AS r FROM e) WHERE r = 1""",
        "confusion": "SELECT quality::VARCHAR AS gold, count(*) AS n, count(*) FILTER (quality = toxic) AS n_right, round(count(*) FILTER (quality = toxic)::DOUBLE / count(*), 6) AS accuracy FROM labels GROUP BY ROLLUP (quality)",
        "article_titles": f"""SELECT source, id, language, title FROM (SELECT *, row_number() OVER (PARTITION BY source, id, language ORDER BY CASE subtree WHEN 'professional' THEN 1 WHEN 'amateur' THEN 2 ELSE 3 END) AS r FROM ({VIEWS}) WHERE length(trim(text)) > 0) WHERE r = 1""",
        "site_pairs": f"""WITH v AS (SELECT DISTINCT source, id, language || '/' || subtree AS view FROM ({VIEWS}) WHERE length(trim(text)) > 0) SELECT source, id, a.view AS view_a, b.view AS view_b, 'richtig' AS label FROM v a JOIN v b USING (source, id) WHERE a.view < b.view""",
        "title_expansion": f"{titled}, x AS (SELECT DISTINCT substring(text, 1, 12) AS t, doc_id::VARCHAR AS n FROM documents) SELECT DISTINCT a.n AS a, b.n AS b FROM tp JOIN x a ON a.t = title_a JOIN x b ON b.t = title_b WHERE a.n <> b.n",
        "canonical_edges": f"""WITH e AS (SELECT *, CASE label WHEN 'richtig_1' THEN 'richtig' WHEN 'False' THEN 'falsch' ELSE label END AS l FROM ({EDGES}))
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b AND l = 'spezialisierung' THEN 'generalisierung' WHEN a > b AND l = 'generalisierung' THEN 'spezialisierung' ELSE l END AS label, judge, model,
CASE WHEN a > b THEN b_view ELSE a_view END AS a_view, CASE WHEN a > b THEN a_view ELSE b_view END AS b_view FROM e WHERE l <> 'falsch'""",
        "partner_tiers": f"""WITH e AS (SELECT a, b FROM ({EDGES}) WHERE a <> b), z AS (SELECT a, b FROM e UNION SELECT b, a FROM e), m AS (SELECT DISTINCT 'n' || (doc_id % 97) AS node, doc_id % 97 % 4 AS tier FROM documents),
k AS (SELECT x.node, x.tier, count(DISTINCT y.tier) AS k FROM z JOIN m x ON x.node = z.a JOIN m y ON y.node = z.b WHERE x.tier <> y.tier GROUP BY ALL) SELECT tier, coalesce(k, 0) AS n_partners, count(*) AS n FROM m LEFT JOIN k USING (node, tier) GROUP BY ALL""",
        "best_instances": """WITH c AS (SELECT source, doc_id::VARCHAR AS id, doc_id % 4 + 1 AS priority FROM documents WHERE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) BETWEEN 1 AND 1000)
SELECT source, id, priority, ['4_tier', '3_tier', '2_tier', 'unaligned'][priority] AS bucket, row_number() OVER (PARTITION BY priority, source ORDER BY md5('42:' || id), id)::INT AS turn FROM c""",
        "resume_rest": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
        "adjacent_steps": "SELECT * FROM (SELECT n_regionkey AS language, n_nationkey AS pos, n_name AS source, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next FROM nation) WHERE next IS NOT NULL",
        "signed_ranks": f"WITH {SIGNED}",
        "signed_rank_p": f"WITH {SIGNED.rpartition('SELECT metric')[0]} SELECT metric, step, round(CASE WHEN n <= 50 THEN least(1, 2 * least({PATTERNS.format(w='w_plus')}, {PATTERNS.format(w='w_minus')})) ELSE least(1, 2 * {TAIL.format(z='abs(z)')}) END, 6) AS p FROM z JOIN r2 USING (metric, step)",
        "reject_holm": f"""WITH t AS (SELECT *, count(p) OVER (PARTITION BY metric) AS m, row_number() OVER (PARTITION BY metric ORDER BY p) AS r FROM ({TESTS})), b AS (SELECT *, min(CASE WHEN p >= 0.05::DOUBLE / (m - r + 1) THEN r END) OVER (PARTITION BY metric) AS bad FROM t)
SELECT metric, step, coalesce(r < bad, true) AS reject FROM b""",
        "reject_bonferroni": f"SELECT metric, step, p < 0.05::DOUBLE / count(p) OVER (PARTITION BY metric) AS reject FROM ({TESTS})", "reject_none": f"SELECT metric, step, p < 0.05 AS reject FROM ({TESTS})",
        "verdicts": _VERDICT.format(p="1 - p"), "verdicts_two_sided": _VERDICT.format(p="p"),
        "bleed_through": f"""WITH c AS ({CELLS}), m AS (SELECT metric, step, median(d_orig) AS mo, median(d_simp) AS ms FROM c GROUP BY ALL), p AS (SELECT metric, 100 * median(d_simp) / nullif(median(d_orig), 0) AS pooled FROM c GROUP BY metric)
SELECT metric, round(100 * avg(ms) / nullif(avg(mo), 0), 6) AS ratio_of_means, round(median(100 * ms / nullif(mo, 0)), 6) AS median_of_ratios, round(100 * max_by(ms, step) / nullif(max_by(mo, step), 0), 6) AS last_step, round(any_value(pooled), 6) AS pooled FROM m JOIN p USING (metric) GROUP BY metric""",
        "mean_sd": f"SELECT metric, step, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM ({CELLS}) WHERE value <> -1 GROUP BY ALL", "tier_medians": f"SELECT metric, round(median(value) * 0.5, 6) AS median FROM ({CELLS}) GROUP BY metric",
        "box_summary": f"""WITH c AS ({CELLS}), q AS (SELECT metric, step, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM c GROUP BY ALL)
SELECT metric, step, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS lo, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS hi FROM c JOIN q USING (metric, step) GROUP BY ALL""",
        "value_cleaning": "SELECT doc_id % 50 AS id, max_by(n_chars::DOUBLE, doc_id) AS value FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 GROUP BY 1",
        "bigram_perplexity": BIGRAM,
        "adjacent_overlap": f"""WITH {TOK}, s AS (SELECT doc_id, sent_id, coalesce(list(DISTINCT lemma) FILTER (is_alpha AND NOT is_stop), []) AS l FROM tok GROUP BY ALL), n AS (SELECT *, lead(l) OVER (PARTITION BY doc_id ORDER BY sent_id) AS m FROM s)
SELECT doc_id, round(avg(list_has_any(l, m)::INT), 6) AS ansp FROM n WHERE m IS NOT NULL GROUP BY doc_id""",
        "subword_measures": f"""WITH {TOK}, b AS (SELECT doc_id, sent_id, len(regexp_extract_all(sentence, '[^\\s]{{1,4}}')) AS b FROM sx), n AS (SELECT doc_id, sent_id, count(*) AS n FROM tok GROUP BY ALL),
a AS (SELECT doc_id, avg(b) AS bl, avg(b::DOUBLE / n) AS bt FROM b JOIN n USING (doc_id, sent_id) GROUP BY doc_id), o AS (SELECT doc_id, string_agg(text, ' ' ORDER BY sent_id, tok_i) AS t FROM tok WHERE NOT is_stop AND NOT is_alpha GROUP BY doc_id),
r AS (SELECT doc_id, length(trim(text))::DOUBLE / nullif(len(regexp_extract_all(trim(text), '[^\\s]{{1,4}}')), 0) AS r FROM documents)
SELECT doc_id, round(r, 6) AS bpe_char_ratio, round(bl, 6) AS bpe_sentence_length, round(bt, 6) AS avg_bpe_length, round(length(t)::DOUBLE / nullif(len(regexp_extract_all(t, '[^\\s]{{1,4}}')), 0), 6) AS bpe_char_ratio_lex
FROM r LEFT JOIN a USING (doc_id) LEFT JOIN o USING (doc_id)""",
        "masked_rank": f"""WITH {TOK}, f AS (SELECT lemma, count(*) AS c FROM tok GROUP BY lemma), k AS (SELECT lemma, rank() OVER (ORDER BY c DESC) AS r, count(*) OVER () AS v FROM f),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_id) AS n, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY md5('0:' || sent_id || ':' || tok_i), tok_i) AS h FROM tok)
SELECT doc_id, round(avg(r::DOUBLE / v), 6) AS lmfm FROM m JOIN k USING (lemma) WHERE h <= greatest(1, round(n * 0.15::DOUBLE)) GROUP BY doc_id""",
        "keyness_bayes_g": f"""WITH {KEY}, x AS (SELECT *, a + b + c + d AS n, (a + b) * (a + c) / (a + b + c + d) AS ea, (a + b) * (b + d) / (a + b + c + d) AS eb, (c + d) * (a + c) / (a + b + c + d) AS ec, (c + d) * (b + d) / (a + b + c + d) AS ed FROM ke),
y AS (SELECT *, a + sign(ea - a) * least(0.5, abs(ea - a)) AS ya, b + sign(eb - b) * least(0.5, abs(eb - b)) AS yb, c + sign(ec - c) * least(0.5, abs(ec - c)) AS yc, d + sign(ed - d) * least(0.5, abs(ed - d)) AS yd FROM x)
SELECT token, round(ll - ln(n), 6) AS bf, round(CASE WHEN a / (a + c) < b / (b + d) THEN -2 ELSE 2 END * (ya * ln(ya / ea) + yb * ln(yb / eb) + yc * ln(yc / ec) + yd * ln(yd / ed)), 6) AS g FROM y""",
        "knn_by_label": f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS rowid, sqrt(list_sum(list_transform(list_zip({_VA}, {_VB}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS distance FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0)
SELECT query_id, rowid, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rowid) AS rn FROM p) WHERE rn <= 3""",
        "min_distance": f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS rowid, b.label, sqrt(list_sum(list_transform(list_zip({_VA}, {_VB}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, label, round(min(distance), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rowid) AS rn FROM p) WHERE rn <= 5 GROUP BY ALL""",
        "reverse_search": f"""WITH near AS (SELECT query_id, rowid, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rowid) AS rn FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS rowid, sqrt(list_sum(list_transform(list_zip({_VA}, {_VB}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rn <= 5),
{_look('title', 5).replace("WHERE doc_id % 20 = 0", "WHERE doc_id IN (SELECT rowid FROM near)")}
SELECT query_id, arg_min(rowid, nn) AS rowid, round(arg_min(distance, nn), 6) AS distance FROM (SELECT near.query_id, near.rowid, near.distance, near.rn AS nn FROM near JOIN top ON top.query_id = near.rowid AND top.rowid = near.query_id) GROUP BY query_id""",
        "unresolved_titles": f"""{titled}, x AS (SELECT DISTINCT substring(text, 1, 12) AS t FROM documents), y AS (SELECT 'a' AS side, title_a AS title FROM tp UNION ALL SELECT 'b', title_b FROM tp),
l AS (SELECT side, count(*) AS n FROM y ANTI JOIN x ON x.t = y.title GROUP BY side) SELECT side, coalesce(n, 0) AS n FROM (VALUES ('a'), ('b')) s(side) LEFT JOIN l USING (side)""",
        "edge_counts": f"""WITH e AS (SELECT *, CASE label WHEN 'richtig_1' THEN 'richtig' WHEN 'False' THEN 'falsch' ELSE label END AS l FROM ({EDGES})), c AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b,
 CASE WHEN a > b AND l = 'spezialisierung' THEN 'generalisierung' WHEN a > b AND l = 'generalisierung' THEN 'spezialisierung' ELSE l END AS label, judge, model, CASE WHEN a > b THEN b_view ELSE a_view END AS a_view, CASE WHEN a > b THEN a_view ELSE b_view END AS b_view FROM e)
SELECT judge, label, count(*) AS n FROM c GROUP BY ROLLUP (judge, label)""",
        "rule_judge": f"""{titled}, l AS (SELECT *, lower(trim(title_a)) AS x, lower(trim(title_b)) AS y FROM tp)
SELECT language, id_a, id_b, CASE WHEN x = y THEN 'richtig' WHEN contains(x, y) THEN 'spezialisierung' WHEN contains(y, x) THEN 'generalisierung' ELSE 'falsch' END AS pred FROM l""",
        "oriented_deltas": """WITH v AS (SELECT o_orderkey AS id, o_totalprice AS value FROM orders), t AS (SELECT DISTINCT o_orderpriority AS sa, o_orderstatus AS sb FROM orders),
p AS (SELECT DISTINCT sa, sb, o_orderkey AS a, o_custkey AS b FROM orders JOIN t ON sa = o_orderpriority AND sb = o_orderstatus)
SELECT sa, sb, a, b, round(x.value, 6) AS va, round(y.value, 6) AS vb, round(y.value - x.value, 6) AS delta FROM p JOIN v x ON x.id = a JOIN v y ON y.id = b""",
        "simplify_rule": rf"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+') AS ss FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(ss, lambda x: trim(CASE WHEN len(string_split_regex(trim(x), ' +')) > 12 THEN regexp_replace(x, '[,;] +', '. ', 'g') ELSE x END)), ' ')) AS text FROM s""",
        "split_registry": "SELECT * FROM (VALUES ('msd','professional','de'), ('msd','amateur','de'), ('msd','short','de'), ('gesund','amateur','de'), ('apoum','amateur','de')) t(source, subtree, language)",
    }
