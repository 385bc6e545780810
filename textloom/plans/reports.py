"""Queries of the jobs over whole corpora, significance tables, stores, dictionaries, clusters and judging, with their SQL.

As in the registry, the tables stand in for a corpus; numbers modulo small ones make groups, as data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import annotate, drivers, index, keyness, linkage, search, significance, stats, store
from textloom.plans import registry as R
from textloom.plans.registry import rounded, table


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _sql_pick(values, number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{number} % {len(values)} + 1]"


# ---- measures and jargon --------------------------------------------------------------------------------

def _articles(s, d):
    return table(s, d, "documents").select("source", F.lit("amateur").alias("subtree"), F.col("lang").alias("language"), F.col("doc_id").alias("article_id"), "text")


def _metric_table(s, d):
    """All thirty measures of the articles that the labelled ones leave, as a resumed run makes them."""
    rest = linkage.remaining(_articles(s, d), table(s, d, "labels").select(F.col("doc_id").alias("article_id")), ["article_id"])
    wide = drivers.measured(rest, R._freq_table(s, d), mode="plain").select("article_id", "language", *drivers.MEASURES)
    digits = {"heaps_law_beta": 4, "heaps_law_beta_lex": 4, "word_freq": 8, "word_freq_filtered": 8}
    return wide.withColumns({c: F.round(c, digits.get(c, 6)) for c in drivers.MEASURES})


def _metric_sql() -> str:
    """The measures' own queries joined; -1 for undefined."""
    own = R.oracle_sql()
    parts = ("document_measures", "syntax_measures", "moving_ttr", "heaps_beta", "heaps_beta_lex", "lexical_chains", "noun_phrases", "tree_depth", "subword_measures", "word_frequency")
    joins = " ".join(f"LEFT JOIN ({own[p]}) t{i} USING (doc_id)" for i, p in enumerate(parts))
    return f"SELECT doc_id AS article_id, lang AS language, {', '.join(f'coalesce({c}::DOUBLE, -1.0) AS {c}' for c in drivers.MEASURES)} FROM (SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)) {joins}"


def _language_tables(s, d):
    low = lambda df: R._words(df).withColumn("lemma", F.lower("lemma"))
    ref = keyness.frequencies(low(table(s, d, "benchmark")))
    docs = table(s, d, "documents")
    return {x: keyness.compare(keyness.frequencies(low(docs.where(F.col("lang") == x))), ref, ("or",)) for x in keyness.COMPARISONS}


def _jargon_by_language(s, d):
    tok = R._words(table(s, d, "documents"), "doc_id", F.col("lang").alias("language")).withColumn("lemma", F.lower("lemma"))
    return keyness.jargon_by_language(tok, _language_tables(s, d))


def _jargon_sql(lang: str) -> str:
    key = R.KEY.replace("FROM documents)", f"FROM documents WHERE lang = '{lang}')")
    words = R.DOC_WORDS.replace("FROM documents)", f"FROM documents WHERE lang = '{lang}')")
    return f"""SELECT * FROM (WITH {key}, {words}, t AS (SELECT doc_id, token, count(*) AS n FROM dw GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS total_tokens, coalesce(sum(n) FILTER ("or" > 20 AND ref_rel_freq <= 0.001::DOUBLE), 0)::BIGINT AS jargon_count,
 round(100.0 * coalesce(sum(n) FILTER ("or" > 20 AND ref_rel_freq <= 0.001::DOUBLE), 0) / sum(n), 4) AS jargon_per_100, '{lang}' AS language FROM t JOIN ke USING (token) GROUP BY doc_id)"""


def _detector(s, d):
    return keyness.JargonDetector(R._jargon_table(s, d))


def _asked(s, d):
    """Words asked about: those of the benchmark and the nations' names, which it lacks."""
    ref = R._words(table(s, d, "benchmark")).select(F.lower("lemma").alias("word"))
    return ref.unionAll(table(s, d, "nation").select(F.concat(F.lit("x"), F.lower("n_name")))).distinct()


ASKED = f"w AS (SELECT DISTINCT lower(t) AS word FROM (SELECT unnest(regexp_extract_all(text, {R.WORDS})) AS t FROM benchmark) UNION SELECT 'x' || lower(n_name) FROM nation)"


# ---- significance ---------------------------------------------------------------------------------------

def _sig_tests(s, d):
    """Cells of two languages' families, with p-values as data."""
    k = F.col("c_custkey")
    c = table(s, d, "customer").groupBy(F.when(F.col("c_nationkey") % 2 == 0, "de").otherwise("en").alias("language"), F.col("c_mktsegment").alias("metric"), (k % 3).cast("int").alias("pos"))
    c = c.agg((F.sum(k * 31 % 97) % 11 - 3).cast("double").alias("delta"), (F.sum(k) % 997 / 150000.0).alias("p"))
    return c.withColumn("expected", (F.length("metric") % 3 - 1).cast("int"))


SIG = """c AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'de' ELSE 'en' END AS language, c_mktsegment AS metric, (c_custkey % 3)::INT AS pos, (sum(c_custkey * 31 % 97) % 11 - 3)::DOUBLE AS delta, sum(c_custkey) % 997 / 150000.0::DOUBLE AS p FROM customer GROUP BY ALL),
e AS (SELECT *, (length(metric) % 3 - 1)::INT AS expected FROM c), r AS (SELECT *, delta * expected > 0 AS "right" FROM e WHERE expected <> 0), t AS (SELECT *, CASE WHEN "right" THEN p ELSE 1 - p END AS pt FROM r),
h AS (SELECT *, count(*) OVER (PARTITION BY language) AS m, row_number() OVER (PARTITION BY language ORDER BY pt) AS k FROM t),
b AS (SELECT *, min(CASE WHEN pt >= 0.05::DOUBLE / (m - k + 1) THEN k END) OVER (PARTITION BY language) AS bad FROM h), sg AS (SELECT *, coalesce(k < bad, true) AS sig FROM b)"""


def _sig(s, d):
    return significance.significance_cells(_sig_tests(s, d))


CHAIN = ("s1", "s2", "s3", "s4", "s5")
METRICS = [("total", 1), ("number", -1), ("none", 0)]


def _direction(s, d):
    """Orders by priority as sources, customers as articles; customers of neighbouring numbers are aligned."""
    o = table(s, d, "orders").groupBy(F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("source"), F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    v = o.select("source", "id", F.explode(F.create_map(F.lit("total"), "t", F.lit("number"), "n", F.lit("none"), "n")).alias("metric", "value"))
    k = F.col("c_custkey")
    e = table(s, d, "customer").select(k.alias("a"), (k + 1).alias("b"), F.concat(F.lit("s"), (k % 4 + 1).cast("string")).alias("source_a"), F.concat(F.lit("s"), (k % 4 + 2).cast("string")).alias("source_b"))
    return s.createDataFrame(METRICS, "metric string, expected int"), significance.step_pairs(e, CHAIN), v


def _direction_cells(s, d):
    m, pairs, v = _direction(s, d)
    c = significance.cells(m, CHAIN, pairs, v)
    return rounded(c.select("metric", "sa", "sb", "n_pairs", "n_values", "delta", F.col("n").alias("n_nonzero"), "w_plus", "z"), 4)


DIRECTION = """WITH o AS (SELECT 's' || substring(o_orderpriority, 1, 1) AS source, o_custkey AS id, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS t, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
v AS (SELECT source, id, 'total' AS metric, t AS value FROM o UNION ALL SELECT source, id, 'number', n FROM o UNION ALL SELECT source, id, 'none', n FROM o),
p AS (SELECT DISTINCT 's' || (c_custkey % 4 + 1) AS sa, 's' || (c_custkey % 4 + 2) AS sb, c_custkey AS a, c_custkey + 1 AS b FROM customer), np AS (SELECT sa, sb, count(*) AS n_pairs FROM p GROUP BY ALL),
dl AS (SELECT x.metric, sa, sb, y.value - x.value AS delta FROM p JOIN v x ON x.source = sa AND x.id = a JOIN v y ON y.source = sb AND y.id = b AND y.metric = x.metric),
md AS (SELECT metric, sa, sb, count(*) AS n_values, median(delta) AS delta FROM dl GROUP BY ALL), t AS (SELECT metric, sa, sb, abs(delta) AS m, count(*) AS t, count(*) FILTER (delta > 0) AS pos FROM dl WHERE delta <> 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY metric, sa, sb ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM t),
a AS (SELECT metric, sa, sb, sum(t)::BIGINT AS n, sum(rank * pos) AS w_plus, sum(t::HUGEINT * t * t - t)::BIGINT AS ties FROM r GROUP BY ALL),
g AS (SELECT metric, sa, sb FROM (VALUES ('total'), ('number'), ('none')) m(metric), (VALUES ('s1', 's2'), ('s2', 's3'), ('s3', 's4'), ('s4', 's5')) s(sa, sb))
SELECT metric, sa, sb, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_values, 0) AS n_values, round(delta, 4) AS delta, n AS n_nonzero, round(w_plus, 4) AS w_plus,
 round((w_plus - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48.0), 4) AS z FROM g LEFT JOIN md USING (metric, sa, sb) LEFT JOIN a USING (metric, sa, sb) LEFT JOIN np USING (sa, sb)"""


# ---- from values to markers -----------------------------------------------------------------------------

def _aligned(s, d):
    """Every fourth document is an article of one view; edges tie the k-th articles of the views in several ways."""
    i, k = F.col("doc_id"), F.floor(F.col("doc_id") / 4)
    docs = table(s, d, "documents").where("doc_id is not null")
    name = F.concat(F.lit("x"), k.cast("string"))
    kind = i % 5
    ends = [("msd", "msd"), ("msd", "gesund"), ("apoum", "gesund"), ("gesund", "nhs"), ("msd", "nhs")]
    at = lambda n: F.element_at(F.array(*(F.lit(e[n]) for e in ends)), (kind + 1).cast("int"))
    views = [("de_professional", "de_amateur"), ("de_amateur", "de_professional"), ("en_professional", "en_amateur"), ("de_amateur", "en_amateur")]
    view = lambda n: F.element_at(F.array(*(F.lit(v[n]) for v in views)), (k % 4 + 1).cast("int"))
    edges = docs.select(name.alias("a"), F.concat(F.lit("x"), (k + F.when((kind == 0) | (i % 3 > 0), 0).otherwise(1)).cast("string")).alias("b"), at(0).alias("source_a"), at(1).alias("source_b"),
                        view(0).alias("a_view"), view(1).alias("b_view"), _pick(("richtig", "spezialisierung", "falsch"), F.floor(i / 7)).alias("label"), _pick(("human", "llm", "site"), F.floor(i / 11)).alias("judge"))
    value = F.create_map(F.lit("chars"), F.col("n_chars").cast("double"), F.lit("spread"), (i * 37 % 101).cast("double"), F.lit("free"), F.lit(1.0))
    views_of = F.array(*map(F.lit, ("msd_expert", "msd_lay", "gesund", "apoum", "nhs")))
    every = docs.select(name.alias("id"), (i % 4).alias("c"), F.explode(views_of).alias("source"), value.alias("v")).where("(case source when 'msd_expert' then 0 when 'msd_lay' then 1 when 'gesund' then 2 else 3 end) = c")
    return edges, every.select("source", "id", F.explode("v").alias("metric", "value")), s.createDataFrame([("chars", -1), ("spread", 1), ("free", 0)], "metric string, expected int")


ALIGNED = f"""ed AS (SELECT 'x' || (doc_id // 4) AS a, 'x' || (doc_id // 4 + CASE WHEN doc_id % 5 = 0 OR doc_id % 3 > 0 THEN 0 ELSE 1 END) AS b, ['msd','msd','apoum','gesund','msd'][doc_id % 5 + 1] AS sa0, ['msd','gesund','gesund','nhs','nhs'][doc_id % 5 + 1] AS sb0,
 ['de_professional','de_amateur','en_professional','de_amateur'][(doc_id // 4) % 4 + 1] AS av, ['de_amateur','de_professional','en_amateur','en_amateur'][(doc_id // 4) % 4 + 1] AS bv, {_sql_pick(('richtig', 'spezialisierung', 'falsch'), '(doc_id // 7)')} AS label,
 {_sql_pick(('human', 'llm', 'site'), '(doc_id // 11)')} AS judge FROM documents),
ok AS (SELECT * FROM ed WHERE label IN ('richtig', 'spezialisierung') AND judge IN ('human', 'site')),
vv AS (SELECT 'x' || (doc_id // 4) AS id, unnest(CASE doc_id % 4 WHEN 0 THEN ['msd_expert'] WHEN 1 THEN ['msd_lay'] WHEN 2 THEN ['gesund'] ELSE ['apoum', 'nhs'] END) AS source, n_chars::DOUBLE AS chars, (doc_id * 37 % 101)::DOUBLE AS spread FROM documents),
v AS (SELECT id, source, 'chars' AS metric, chars AS value FROM vv UNION ALL SELECT id, source, 'spread', spread FROM vv),
st AS (SELECT * FROM (VALUES ('de', 0, 'msd_expert', 'msd_lay', 'msd', 'msd'), ('de', 1, 'msd_lay', 'gesund', 'msd', 'gesund'), ('de', 2, 'gesund', 'apoum', 'gesund', 'apoum'),
 ('en', 0, 'msd_expert', 'msd_lay', 'msd', 'msd'), ('en', 1, 'msd_lay', 'gesund', 'msd', 'gesund'), ('en', 2, 'gesund', 'nhs', 'gesund', 'nhs')) t(language, pos, sa, sb, na, nb)),
pr AS (SELECT DISTINCT language, pos, sa, sb, CASE WHEN ahead THEN a ELSE b END AS a, CASE WHEN ahead THEN b ELSE a END AS b FROM (SELECT *, CASE WHEN na = nb THEN a = b AND av = language || '_professional' AND bv = language || '_amateur' ELSE true END AND sa0 = na AND sb0 = nb AS ahead,
 CASE WHEN na = nb THEN a = b AND bv = language || '_professional' AND av = language || '_amateur' ELSE true END AND sa0 = nb AND sb0 = na AS back FROM ok, st) WHERE ahead OR back)"""
ALIGNED_TESTS = f"""{ALIGNED}, dl AS (SELECT language, x.metric, pos, pr.sa, pr.sb, y.value - x.value AS delta FROM pr JOIN v x ON x.source = sa AND x.id = a JOIN v y ON y.source = sb AND y.id = b AND y.metric = x.metric),
md AS (SELECT language, metric, pos, count(*) AS n_values, median(delta) AS delta FROM dl GROUP BY ALL), tt AS (SELECT language, metric, pos, abs(delta) AS m, count(*) AS t, count(*) FILTER (delta > 0) AS up FROM dl WHERE delta <> 0 GROUP BY ALL),
rr AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY language, metric, pos ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM tt),
aa AS (SELECT language, metric, pos, sum(t)::DOUBLE AS n, sum(rank * up) AS w, sum(t::HUGEINT * t * t - t)::DOUBLE AS ties, flatten(list(list_transform(range(t), lambda i: (2 * rank)::DOUBLE))) AS r2 FROM rr GROUP BY ALL),
zz AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) * CASE metric WHEN 'chars' THEN -1 ELSE 1 END AS z, CASE metric WHEN 'chars' THEN -1 ELSE 1 END AS expected FROM aa JOIN md USING (language, metric, pos)),
pp AS (SELECT *, CASE WHEN n > 50 THEN {R.TAIL.format(z='z')} WHEN expected > 0 THEN {R.PATTERNS.format(w='w')} ELSE {R.PATTERNS.format(w='(n * (n + 1) / 2 - w)')} END AS p, delta * expected > 0 AS "right" FROM zz), tw AS (SELECT *, CASE WHEN "right" THEN p ELSE 1 - p END AS pt FROM pp),
ho AS (SELECT *, count(*) OVER (PARTITION BY language) AS k, row_number() OVER (PARTITION BY language ORDER BY pt) AS r FROM tw), bd AS (SELECT *, min(CASE WHEN pt >= 0.05::DOUBLE / (k - r + 1) THEN r END) OVER (PARTITION BY language) AS bad FROM ho),
sg AS (SELECT *, coalesce(r < bad, true) AS sig FROM bd), em AS (SELECT language, metric, count(*) FILTER ("right" AND sig) AS good, count(*) FILTER (NOT "right" AND sig) AS wrong, count(*) AS n FROM sg GROUP BY ALL)"""


def _aligned_steps(s, d):
    edges = _aligned(s, d)[0].where("label in ('richtig', 'spezialisierung') and judge in ('human', 'site')")
    one = lambda lang: significance.step_pairs(edges, significance.CHAINS[lang], lang).select(F.lit(lang).alias("language"), "*")
    return one("de").unionByName(one("en"))


def _aligned_significance(s, d):
    edges, values, registry = _aligned(s, d)
    one = lambda lang: significance.aligned_significance(edges, values, registry, lang, ("richtig", "spezialisierung"), ("human", "site"))
    return rounded(one("de").unionByName(one("en")).select("language", "metric", "pos", "n_values", "delta", "p", "right", "sig", "marker", "emphasis"))


def _bleed_steps(s, d):
    k = F.col("c_custkey")
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("metric"), (k % 3).cast("int").alias("step"))
    return c.agg((F.sum(k * 31 % 97) % 13 - 2).cast("double").alias("simp"), (F.sum(k) % 17 + 1).cast("double").alias("orig"), (F.sum(k) % 997 / 9970.0).alias("p")).withColumn("language", F.when(F.col("n") % 2 == 0, "de").otherwise("en"))


BLEED = """st AS (SELECT c_nationkey AS n, c_mktsegment AS metric, (c_custkey % 3)::INT AS step, (sum(c_custkey * 31 % 97) % 13 - 2)::DOUBLE AS simp, (sum(c_custkey) % 17 + 1)::DOUBLE AS orig, sum(c_custkey) % 997 / 9970.0::DOUBLE AS p FROM customer GROUP BY ALL),
pr AS (SELECT n, metric, count(*) FILTER (simp > 0 AND p < 0.05::DOUBLE) AS r, count(*) FILTER (simp <= 0 AND 1 - p < 0.05::DOUBLE) AS w, count(*) AS k, 100 * avg(simp) / nullif(avg(orig), 0) AS pct FROM st GROUP BY ALL),
br AS (SELECT n, metric, CASE WHEN w > 0 OR k < 3 THEN '' ELSE repeat('*', r::INT) END AS stars, round(pct, 6) AS bleed_pct FROM pr)"""


def _bleed_grid(s, d):
    """One nation stands for each language; a segment is confirmed where its name is long enough."""
    rep = significance.bleed_report(_bleed_steps(s, d).where("n in (2, 3)"), ["language", "metric"], 3)
    seg = table(s, d, "customer").select(F.col("c_mktsegment").alias("metric")).distinct()
    sure = seg.where("length(metric) > 8").withColumn("language", F.lit("de")).unionAll(seg.where("length(metric) < 10").withColumn("language", F.lit("en")))
    return rounded(significance.bleed_grid(rep, sure))


def _releases(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").select(_pick(("msd", "gesund", "apoum", "nhs"), i).alias("source"), _pick(("professional", "amateur", "short"), i).alias("subtree"), _pick(("de", "en"), i).alias("language"),
                                           F.when(i % 23 == 0, "").otherwise(F.concat((i / 24).cast("int").cast("string"), F.lit("_x"))).alias("article_id"))


RELEASES = f"""rl AS (SELECT {_sql_pick(('msd', 'gesund', 'apoum', 'nhs'), 'doc_id')} AS source, {_sql_pick(('professional', 'amateur', 'short'), 'doc_id')} AS subtree, {_sql_pick(('de', 'en'), 'doc_id')} AS language, doc_id // 24 AS k FROM documents WHERE doc_id % 23 <> 0),
mb AS (SELECT DISTINCT language, CASE WHEN source = 'msd' AND subtree = 'professional' THEN 'msd_expert' WHEN source = 'msd' THEN 'msd_lay' ELSE source END AS tier, source || ':' || k || CASE WHEN source IN ('apoum', 'nhs') THEN '_x' ELSE '' END AS node
 FROM rl WHERE (source = 'msd' AND subtree <> 'short') OR (source <> 'msd' AND subtree = 'amateur'))"""


# ---- stores and linking ---------------------------------------------------------------------------------

def _store_append(s, d):
    rows = R._titles(s, d).withColumns({"metadata": F.to_json(F.struct("source", "language")), "embedding": F.array(F.col("doc_id").cast("double"))})
    got = store.prepared(rows, ("title", "text", "doc_id"), 100)
    return got.select("rowid", F.col("embedding")[0].cast("long").alias("doc_id"), "title_lower", "metadata")


def _highlights(s, d):
    rows = R._rows(s, d).withColumn("metadata", F.to_json(F.struct("source")))
    docs = rows.select("rowid", "title", "text", "metadata")
    got = store.highlighted(docs, index.build(rows, ("title",)), R._asked(rows), 5)
    return got.select("query_id", "rowid", "rn", "title", F.md5(F.col("text").cast("binary")).alias("text"), F.to_json("offsets").alias("offsets"))


KEYS = ("doid", "icd10", "mesh", "descriptor_ui", "pschyrembel_id", "instance_id")


def _external_links(s, d):
    i = F.col("doc_id")
    key = _pick(KEYS, i)
    value = F.when(key.isin("mesh", "descriptor_ui"), F.concat(F.lit("D"), i.cast("string"), F.lit("; D"), (i % 50).cast("string"))).when((key == "instance_id") & (i % 4 == 1), F.concat(F.lit("a-"), i.cast("string"))).otherwise((i % 90).cast("string"))
    return store.external_links(table(s, d, "documents").select(F.floor(i / 12).alias("id"), key.alias("key"), F.array(value, F.lit(None).cast("string")).alias("values")))


EXTERNAL = f"""WITH f AS (SELECT doc_id // 12 AS id, doc_id AS i, {_sql_pick(KEYS, 'doc_id')} AS key FROM documents),
x AS (SELECT id, CASE WHEN key = 'instance_id' THEN CASE WHEN i % 4 = 1 THEN 'MSD' ELSE 'GesundBund' END WHEN key = 'doid' THEN 'DOID' WHEN key = 'icd10' THEN 'ICD-10CM' WHEN key = 'pschyrembel_id' THEN 'Pschyrembel' ELSE 'MeSH' END AS vocab,
 unnest(CASE WHEN key IN ('mesh', 'descriptor_ui') THEN ['D' || i, 'D' || (i % 50)] WHEN key = 'instance_id' AND i % 4 = 1 THEN ['a-' || i] ELSE [(i % 90)::VARCHAR] END) AS value FROM f)
SELECT DISTINCT id, vocab, value FROM x"""


def _looked_up(s, d):
    """Every document's title is looked up among all titles; a document without a number has no search of its own."""
    rows = R._rows(s, d)
    got = store.looked_up(R._title_queries(rows.where("rowid is not null")), rows, ("source", "language"))
    return got.select("id", "key", F.array_join("values", ",").alias("found"))


_LOOK_ALL = R._look("title", 5).replace("WHERE doc_id % 20 = 0", "WHERE doc_id IS NOT NULL")
LOOKED_UP = f"""WITH {_LOOK_ALL}, j AS (SELECT t.query_id, t.rn, ti.source, ti.language FROM top t JOIN ti ON ti.doc_id = t.rowid)
SELECT query_id AS id, 'source' AS key, array_to_string(list_sort(list(DISTINCT source) FILTER (source <> '')), ',') AS found FROM j GROUP BY query_id HAVING bool_or(rn = 1 AND source IS NOT NULL)
UNION ALL SELECT query_id, 'language', array_to_string(list_sort(list(DISTINCT language) FILTER (language <> '')), ',') FROM j GROUP BY query_id HAVING bool_or(rn = 1 AND language IS NOT NULL)"""


def _assigned(s, d):
    """Every third queried record has links; the others find themselves, as the dictionary holds them."""
    e = table(s, d, "embeddings")
    rec = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("id"), F.col("embedding").alias("q"))
    links = e.where(F.col("vec_id") % 20 == 0).where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("id"), F.explode(F.array((F.col("label") + 1), (F.col("label") + 2))).alias("key"))
    dic = e.select(F.col("vec_id").alias("rowid"), F.col("label").cast("long").alias("key"), "embedding")
    back = e.select(F.col("vec_id").alias("rowid"), F.col("vec_id").alias("query_id"))
    return rounded(store.assigned_distances(rec, links.withColumn("key", F.col("key").cast("long")), dic, back), 5)


_L2 = "sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
ASSIGNED = f"""WITH k AS (SELECT a.vec_id AS id, b.label AS key, {_L2} AS distance, b.vec_id AS r FROM embeddings a JOIN embeddings b ON b.label IN (a.label + 1, a.label + 2) WHERE a.vec_id % 20 = 0 AND a.vec_id % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, r) AS rn FROM k)
SELECT id, key::BIGINT AS key, round(min(distance), 5) AS distance FROM n WHERE rn <= 25 GROUP BY ALL UNION ALL SELECT vec_id, label, 0.0 FROM embeddings a WHERE vec_id % 20 = 0 AND NOT (vec_id % 3 = 0)"""


def _store_rows(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.col("lang").alias("language"), F.substring("text", 1, 40).alias("title"), "text")
    return store.store_rows(rows, table(s, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], ["vec_id", "source", "language"]).select("metadata", "title", F.size("embedding").cast("long").alias("width"))


# ---- dictionaries, clusters, judging ----------------------------------------------------------------------

def _other_names(s, d):
    p = table(s, d, "part")
    terms = p.select(F.col("p_partkey").alias("term"), (F.col("p_partkey") % 40).alias("descriptor_ui"), (F.col("p_partkey") % 70).alias("concept_ui"))
    other = p.where(F.col("p_partkey") % 40 < 30).select((F.col("p_partkey") % 40).alias("descriptor_ui"), F.col("p_name").alias("descriptor_name"), (F.col("p_partkey") % 90).alias("concept_ui"), F.col("p_type").alias("concept_name"), F.col("p_partkey").alias("pos"))
    return linkage.other_names(terms, other).select("term", "descriptor_name_other", "concept_name_other")


OTHER = """WITH o AS (SELECT * FROM part WHERE p_partkey % 40 < 30), a AS (SELECT p_partkey % 40 AS u, max_by(p_name, p_partkey) AS n FROM o GROUP BY 1), b AS (SELECT p_partkey % 90 AS u, max_by(p_type, p_partkey) AS n FROM o GROUP BY 1)
SELECT p_partkey AS term, a.n AS descriptor_name_other, b.n AS concept_name_other FROM part LEFT JOIN a ON a.u = p_partkey % 40 LEFT JOIN b ON b.u = p_partkey % 70"""


def _members(s, d):
    a = R._atoms(s, d).withColumn("row", F.concat("language", F.col("cluster_id").cast("string")))
    near = a.withColumn("row", F.concat("language", (F.col("cluster_id") + 1000000).cast("string")))  # the same ids in a second row
    return a.unionAll(near).select("row", "source", "id", F.concat(F.lit("t"), (F.col("id").cast("long") % 7).cast("string")).alias("title"))


MERGED = f"""WITH ats AS ({R.ATOMS}), m AS (SELECT language || cluster_id AS k, source, id, 't' || (id::BIGINT % 7) AS title FROM ats),
own AS (SELECT k, string_agg(DISTINCT id, '; ' ORDER BY id) AS ids FROM m WHERE source = 'msd' GROUP BY k), e AS (SELECT DISTINCT ids, source, id, title, CASE WHEN source IN ('gesund', 'apoum') THEN lpad(id, 20, '0') ELSE id END AS p FROM m JOIN own USING (k)),
f AS (SELECT ids, source, title, min(p) AS p FROM e GROUP BY ALL)
SELECT x.ids, x.source, x.id, y.title FROM (SELECT ids, source, string_agg(id, '; ' ORDER BY p) AS id FROM e GROUP BY ALL) x JOIN (SELECT ids, source, string_agg(title, '; ' ORDER BY p) AS title FROM f GROUP BY ALL) y USING (ids, source)"""


def _cross(s, d):
    e = table(s, d, "embeddings")
    edges = e.select(F.col("vec_id").alias("a"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") * 7 % 501)).alias("b"))
    return rounded(linkage.linked_distances(edges, e.select(F.col("vec_id").alias("node"), "embedding"), lambda x, y: search.distance(x, y, "l2")))


def _sheet(s, d, names=("MSD_title", "gesund_title", "NHS_title")):
    i, src, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    label = _pick(("richtig_1", "richtig_2", "False", "Richtig", "generalisierung"), i)
    return table(s, d, "documents").select(i.alias("row"), F.concat(src, F.lit(" ; "), lang).alias("MSD_title"), F.when(i % 3 == 0, F.concat(F.lit(";"), lang)).alias("gesund_title"), F.concat(src, (i % 5).cast("string")).alias("NHS_title"),
                                           F.concat(lang, (i % 6).cast("string"), F.lit("; "), src).alias("apoum_title"), F.when(i % 4 > 0, label).alias("comments"))


SHEET = """sh AS (SELECT doc_id AS r, [source, lang] || CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE [] END || [source || (doc_id % 5)] AS ss, [lang || (doc_id % 6), source] AS ts,
 CASE WHEN doc_id % 4 > 0 THEN ['richtig', 'richtig', 'falsch', 'Richtig', 'generalisierung'][doc_id % 5 + 1] END AS label FROM documents),
al AS (SELECT r, label, s AS source, unnest(ts) AS target FROM (SELECT r, label, ts, unnest(ss) AS s FROM sh))"""


def title_judge(a: str, b: str):
    """A stand-in judge: equal titles are right, others wrong; titles' letters count as tokens."""
    return ("richtig" if a == b else "falsch"), {"prompt_tokens": len(a) + len(b), "cached_tokens": len(a), "completion_tokens": 1}


def _judged(s, d):
    g = linkage.gold_title_pairs(_sheet(s, d)).select(F.col("source").alias("title_a"), F.col("target").alias("title_b"))
    return linkage.judged(g, title_judge)


def _eval_report(s, d):
    return rounded(linkage.evaluated(linkage.eval_pairs(_sheet(s, d)), title_judge)[1])


def _job_items(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").select(_pick(("de", "en"), i).alias("language"), i.alias("article_id"), _pick(("4_tier", "3_tier", "2_tier"), F.floor(i / 2)).alias("bucket"), (i % 9).alias("turn"), "text")


def _views(s, d):
    i = F.col("doc_id")
    rec = table(s, d, "documents").select(_pick(("msd", "gesund"), i).alias("source"), _pick(("professional", "amateur", "short"), i).alias("subtree"), _pick(("de", "en"), F.floor(i / 2)).alias("language"),
                                          F.floor(i / 30).alias("article_id"), i.alias("pos"), F.when(i % 5 > 0, F.col("text")).alias("markdown"), F.when(i % 7 > 0, F.col("text")).alias("plain_text"))
    one = drivers.index_view(rec, "msd", "amateur", "de", "article_id", "pos")
    return drivers.article_input(one).select("article_id", "pos", F.md5(F.col("input").cast("binary")).alias("input"), F.col("word_count").cast("long").alias("word_count"))


VIEWS = """WITH r AS (SELECT doc_id AS pos, doc_id // 30 AS article_id, CASE WHEN doc_id % 5 > 0 THEN text END AS md, CASE WHEN doc_id % 7 > 0 THEN text END AS pt FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 1 AND (doc_id // 2) % 2 = 0),
l AS (SELECT article_id, max(pos) AS pos FROM r GROUP BY 1), x AS (SELECT r.*, CASE WHEN md IS NOT NULL AND length(trim(regexp_replace(md, '\\s+', ' ', 'g'))) > 0 THEN md WHEN pt IS NOT NULL AND length(trim(regexp_replace(pt, '\\s+', ' ', 'g'))) > 0 THEN pt END AS input FROM r JOIN l USING (article_id, pos))
SELECT article_id, pos, md5(input) AS input, CASE WHEN input IS NOT NULL THEN len(regexp_extract_all(coalesce(pt, md), '[^\\s]+'))::BIGINT END AS word_count FROM x"""


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "metric_table": _metric_table, "jargon_by_language": _jargon_by_language,
        "jargon_analysis": lambda s, d: rounded(_detector(s, d).analyze(R._counted_words(R._docs(s, d), "doc_id"))).select("doc_id", "token", "freq_in_text", "score", "is_jargon", "in_dict"),
        "jargon_identify": lambda s, d: rounded(_detector(s, d).identify(_asked(s, d))),
        "jargon_compare": lambda s, d: rounded(_detector(s, d).compare(_asked(s, d), "ll")).select("word", "score", "in_dict"),
        "jargon_top": lambda s, d: _detector(s, d).terms(R._doc_words(s, d), limit=5).select("doc_id", "place", "token", "freq_in_text"),
        "model_measures": lambda s, d: rounded(drivers.model_measures(docs(s, d)), 4),
        "significance_cells": lambda s, d: rounded(_sig(s, d)).select("language", "metric", "pos", "right", "sig"),
        "significance_markers": lambda s, d: significance.significance_markers(_sig(s, d)).select("language", "metric", "pos", "marker"),
        "label_emphasis": lambda s, d: significance.label_emphasis(_sig(s, d), 3),
        "significance_brackets": lambda s, d: significance.brackets(_sig(s, d)).select("language", "metric", "pos", "level", "mark", "colour"),
        "direction_cells": _direction_cells, "aligned_steps": _aligned_steps, "aligned_significance": _aligned_significance,
        "direction_table": lambda s, d: rounded(significance.direction_table(significance.cells(m := _direction(s, d)[0], CHAIN, *_direction(s, d)[1:]))).select("metric", "sa", "sb", "delta", "p", "sig", "wrong_sig", "verdict"),
        "direction_wide": lambda s, d: rounded(significance.direction_wide(significance.direction_table(significance.cells(_direction(s, d)[0], CHAIN, *_direction(s, d)[1:])))),
        "source_dependence": lambda s, d: rounded(significance.source_dependence(_direction(s, d)[0], CHAIN, *_direction(s, d)[1:])).select("metric", "sa", "sb", "delta", "p", "sig", "rank_biserial", "pct_positive"),
        "bleed_report": lambda s, d: rounded(significance.bleed_report(_bleed_steps(s, d), ["n", "metric"], 3)), "bleed_grid": _bleed_grid,
        "tier_membership": lambda s, d: significance.tier_membership(_releases(s, d)),
        "node_tiers": lambda s, d: significance.node_tiers(significance.tier_membership(_releases(s, d))).select("language", "node", F.array_join("tiers", ",").alias("tiers")),
        "source_labels": lambda s, d: significance.labelled(significance.tier_membership(_releases(s, d)), "tier").select("tier", "label").distinct(),
        "social_tokens": lambda s, d: annotate.social_tokens(docs(s, d), "text", "doc_id").groupBy("token").agg(F.count("*").alias("n")),
        "treebank_tokens": lambda s, d: annotate.treebank_tokens(docs(s, d), "text", "doc_id").groupBy("token").agg(F.count("*").alias("n")),
        "search_tokens": lambda s, d: annotate.search_tokens(docs(s, d)),
        "store_append": _store_append, "search_highlight": _highlights, "external_links": _external_links, "lookup_links": _looked_up, "assigned_distances": _assigned, "store_rows": _store_rows,
        "other_names": _other_names,
        "wiki_links": lambda s, d: linkage.link_table(docs(s, d).select((F.col("doc_id") % 60).alias("id"), F.array(F.concat(F.lit("w/"), "source"), F.concat(F.lit("w/"), "lang")).alias("urls")), "id", "urls"),
        "translations": lambda s, d: linkage.translations(table(s, d, "part").select((F.col("p_partkey") % 300).alias("id"), F.when(F.col("p_partkey") % 9 == 0, F.concat("p_brand", F.lit(", "), "p_type")).when(F.col("p_partkey") % 8 > 0, F.col("p_brand")).alias("name")), "id", "name"),
        "dictionary_metadata": lambda s, d: linkage.dictionary_metadata(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("german"), F.concat("n_name", F.lit("."), F.col("n_regionkey").cast("string")).alias("icd")), "icd", ["german"]).select("n_nationkey", "metadata"),
        "merged_clusters": lambda s, d: linkage.merged_rows(_members(s, d), "msd"), "cross_distances": _cross,
        "pair_counts": lambda s, d: linkage.pair_counts(R._pairs(s, d)),
        "gold_title_pairs": lambda s, d: linkage.gold_title_pairs(_sheet(s, d)),
        "eval_pairs": lambda s, d: linkage.eval_pairs(_sheet(s, d).where("row % 3 > 0"), _sheet(s, d)),
        "judge_usage": lambda s, d: rounded(linkage.usage(_judged(s, d), "pred")), "eval_report": _eval_report,
        "simplify_rest": lambda s, d: drivers.simplify_job(_job_items(s, d), f"{d}/none", dry=True).select("language", "article_id", "bucket"),
        "article_input": _views,
    }


def oracle_sql() -> dict[str, str]:
    pair = f"WITH ats AS ({R.ATOMS}), {R._PAIR}"
    token = annotate.TOKEN
    return {
        "metric_table": _metric_sql(), "jargon_by_language": f"{_jargon_sql('de')} UNION ALL {_jargon_sql('en')}",
        "jargon_analysis": f"""WITH {R.KEY}, {R.DOC_WORDS} SELECT doc_id, token, count(*) AS freq_in_text, round(any_value("or"), 6) AS score, any_value("or") > 20 AS is_jargon, true AS in_dict FROM dw JOIN ke USING (token) GROUP BY doc_id, token""",
        "jargon_identify": f"""WITH {R.KEY}, {ASKED} SELECT word, round(coalesce("or", 1.0), 6) AS score, 'or' AS metric, token IS NOT NULL AS in_dict FROM w LEFT JOIN ke ON ke.token = word""",
        "jargon_compare": f"WITH {R.KEY}, {ASKED} SELECT word, round(coalesce(ll, 0.0), 6) AS score, token IS NOT NULL AS in_dict FROM w LEFT JOIN ke ON ke.token = word",
        "jargon_top": f"""WITH {R.KEY}, {R.DOC_WORDS}, t AS (SELECT doc_id, token, "or" AS o, count(*) AS f FROM dw JOIN ke USING (token) WHERE "or" > 20 AND ref_rel_freq <= 0.001::DOUBLE GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, token)::INT AS place FROM t) SELECT doc_id, place, token, f AS freq_in_text FROM n WHERE place <= 5""",
        "model_measures": f"""SELECT doc_id, appl_filtered_mean, appl_filtered_median, appl_full_mean, appl_full_median, appl_fulltext, round(ansp, 4) AS ansp, round(lmfm, 4) AS lmfm
FROM ({R.BIGRAM}) LEFT JOIN ({R.oracle_sql()["adjacent_overlap"].replace("round(avg(list_has_any(l, m)::INT), 6)", "avg(list_has_any(l, m)::INT)")}) USING (doc_id) LEFT JOIN ({R.oracle_sql()["masked_rank"].replace("round(avg(r::DOUBLE / v), 6)", "avg(r::DOUBLE / v)")}) USING (doc_id)""",
        "significance_cells": f'WITH {SIG} SELECT language, metric, pos, "right", sig FROM sg',
        "significance_markers": f"""WITH {SIG} SELECT language, metric, pos, CASE WHEN sig AND "right" THEN '*' WHEN sig THEN '\\textdagger' ELSE '' END AS marker FROM sg""",
        "label_emphasis": f"""WITH {SIG}, n AS (SELECT language, metric, count(*) FILTER (sig AND "right") AS g, count(*) FILTER (sig AND NOT "right") AS w, count(*) AS k FROM sg GROUP BY ALL)
SELECT language, metric, CASE WHEN w > 0 OR g = 0 OR k < 3 THEN '' WHEN g = 3 THEN 'bold' ELSE 'underline' END AS emphasis FROM n""",
        "significance_brackets": f"""WITH {SIG} SELECT language, metric, pos, (row_number() OVER (PARTITION BY language, metric ORDER BY pos) - 1)::INT AS level, CASE WHEN "right" THEN '*' ELSE '†' END AS mark, CASE WHEN "right" THEN 'black' ELSE '#D55E00' END AS colour FROM sg WHERE sig""",
        "direction_cells": DIRECTION, "aligned_steps": f"WITH {ALIGNED} SELECT language, sa, sb, a, b FROM pr",
        "aligned_significance": f"""WITH {ALIGNED_TESTS} SELECT language, metric, pos, n_values, round(delta, 6) AS delta, round(p, 6) AS p, "right", sig, CASE WHEN sig AND "right" THEN '*' WHEN sig THEN '\\textdagger' ELSE '' END AS marker,
 CASE WHEN wrong > 0 OR good = 0 OR em.n < 3 THEN '' WHEN good = 3 THEN 'bold' ELSE 'underline' END AS emphasis FROM sg JOIN em USING (language, metric)""",
        "bleed_report": f"WITH {BLEED} SELECT * FROM br",
        "bleed_grid": f"""WITH {BLEED}, sg AS (SELECT DISTINCT c_mktsegment AS metric FROM customer), de AS (SELECT * FROM br WHERE n = 2 AND length(metric) > 8), en AS (SELECT * FROM br WHERE n = 3 AND length(metric) < 10)
SELECT sg.metric, de.stars AS de_stars, de.bleed_pct AS de_bleed_pct, en.stars AS en_stars, en.bleed_pct AS en_bleed_pct FROM sg LEFT JOIN de USING (metric) LEFT JOIN en USING (metric)""",
        "tier_membership": f"WITH {RELEASES} SELECT * FROM mb",
        "node_tiers": f"WITH {RELEASES} SELECT language, node, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers FROM mb GROUP BY ALL",
        "source_labels": f"""WITH {RELEASES} SELECT DISTINCT tier, CASE tier WHEN 'apoum' THEN 'Apotheken' || chr(10) || 'Umschau' WHEN 'nhs' THEN 'NHS' WHEN 'gesund' THEN 'gesund.' || chr(10) || 'bund'
 WHEN 'msd_lay' THEN 'MSD' || chr(10) || 'Consumer' ELSE 'MSD Manual' || chr(10) || '(Professional)' END AS label FROM mb""",
        "social_tokens": f"SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{annotate.SOCIAL.replace(chr(39), chr(39) * 2)}')) AS t FROM documents) GROUP BY 1",
        "search_tokens": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{token}') AS ws, string_split_regex(text, '{token}') AS gs FROM documents),
x AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w, unnest(list_slice(gs, 1, len(ws))) AS g FROM w), y AS (SELECT doc_id, i, w, sum(strlen(g) + strlen(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM x)
SELECT doc_id, i::INT AS i, lower(w) AS term, (e - strlen(w))::INT AS start, e::INT AS "end" FROM y""",
        "store_append": """SELECT 100 + row_number() OVER (ORDER BY substring(split_part(text, chr(10), 1), 1, 40), text, doc_id) AS rowid, doc_id, lower(substring(split_part(text, chr(10), 1), 1, 40)) AS title_lower, '{"source":"' || source || '","language":"' || lang || '"}' AS metadata FROM documents""",
        "external_links": EXTERNAL, "lookup_links": LOOKED_UP, "assigned_distances": ASSIGNED,
        "store_rows": """SELECT '{"vec_id":' || vec_id || ',"source":"' || source || '","language":"' || lang || '"}' AS metadata, substring(text, 1, 40) AS title, len(embedding) AS width FROM documents JOIN embeddings ON vec_id = doc_id""",
        "other_names": OTHER,
        "wiki_links": "SELECT DISTINCT doc_id % 60 AS id, unnest(['w/' || source, 'w/' || lang]) AS url FROM documents",
        "translations": "SELECT DISTINCT p_partkey % 300 AS id, p_brand AS name FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 8 > 0 AND p_brand IS NOT NULL AND NOT contains(p_brand, ', ')",
        "dictionary_metadata": """SELECT n_nationkey, '{"german":"' || n_name || '","icd10":"' || lower(n_name || '.' || n_regionkey) || '"}' AS metadata FROM nation""",
        "merged_clusters": MERGED,
        "cross_distances": f"""WITH e AS (SELECT DISTINCT vec_id AS a, unnest([vec_id + 1, vec_id * 7 % 501]) AS b FROM embeddings) SELECT e.a, e.b, round({_L2}, 6) AS distance FROM e JOIN embeddings a ON a.vec_id = e.a JOIN embeddings b ON b.vec_id = e.b""",
        "pair_counts": f"{pair} SELECT language, source_a, source_b, max_tier, count(*) AS n FROM pr GROUP BY GROUPING SETS ((language), (language, source_a, source_b), (max_tier))",
        "gold_title_pairs": f"WITH {SHEET} SELECT DISTINCT source, target FROM al",
        "eval_pairs": f"""WITH {SHEET}, g AS (SELECT source, target, max_by(label, r) AS label FROM al WHERE label IS NOT NULL AND r % 3 > 0 GROUP BY ALL) SELECT source, target, coalesce(label, 'falsch') AS label FROM (SELECT DISTINCT source, target FROM al) LEFT JOIN g USING (source, target)""",
        "judge_usage": f"""WITH {SHEET}, p AS (SELECT DISTINCT source, target FROM al) SELECT CASE WHEN source = target THEN 'richtig' ELSE 'falsch' END AS pred, count(*) AS requests, sum(length(source) + length(target))::BIGINT AS prompt_tokens,
 sum(length(source))::BIGINT AS cached_tokens, count(*) AS completion_tokens, round(sum(length(source))::DOUBLE / sum(length(source) + length(target)), 6) AS cache_hit_rate FROM p GROUP BY 1""",
        "eval_report": f"""WITH {SHEET}, g AS (SELECT source, target, max_by(label, r) AS gold FROM al WHERE label IS NOT NULL GROUP BY ALL), j AS (SELECT *, CASE WHEN source = target THEN 'richtig' ELSE 'falsch' END AS pred FROM g)
SELECT gold, count(*) AS n, count(*) FILTER (gold = pred) AS n_right, round(count(*) FILTER (gold = pred)::DOUBLE / count(*), 6) AS accuracy FROM j GROUP BY ROLLUP (gold)""",
        "simplify_rest": f"SELECT {_sql_pick(('de', 'en'), 'doc_id')} AS language, doc_id AS article_id, {_sql_pick(('4_tier', '3_tier', '2_tier'), '(doc_id // 2)')} AS bucket FROM documents WHERE NOT (doc_id % 2 = 1 AND (doc_id // 2) % 3 = 0)",
        "article_input": VIEWS,
    }
