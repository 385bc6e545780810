"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from textloom.llm import (bpe_count, fingerprint, langid_gru, lloyd, minhash_circulant, mixing, periodic, quality_gam, secrets, substring_lsm,
                          suffix_dc, topk, winnow)
from textloom.llm.common import load


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    docs = lambda s, d: load(s, d, "documents")
    return {
        "op1_quality_gam": lambda s, d: quality_gam.score(docs(s, d), load(s, d, "labels")),
        "op2_substring_lsm": lambda s, d: substring_lsm.dedup(docs(s, d)),
        "op3_secret_scan": lambda s, d: secrets.report(docs(s, d)),
        "op4_language_gru": lambda s, d: langid_gru.identify(docs(s, d)),
        "op5_token_counts": lambda s, d: bpe_count.count(docs(s, d), tokenizer_path()),
        "op6_minhash_circulant": lambda s, d: minhash_circulant.near_dedup(docs(s, d)),
        "op7_decontaminate": lambda s, d: winnow.decontaminate(docs(s, d), load(s, d, "benchmark")),
        "op8_fingerprint": lambda s, d: fingerprint.report(docs(s, d)),
        "op9_suffix_dedup": lambda s, d: suffix_dc.dedup(docs(s, d)),
        "op10_source_mix": lambda s, d: mixing.mix(docs(s, d)),
        "op11_periodic_runs": lambda s, d: periodic.report(docs(s, d)),
        "op12_dual_tree_lloyd": lambda s, d: lloyd.report(load(s, d, "embeddings")),
        "op13_branch_bound_topk": lambda s, d: topk.report(load(s, d, "embeddings")),
    }


_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACE}), []) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS g FROM x),
low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE lo < doc_id),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(ps, i - 1)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_SPACE}), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(0, len(w) - 2), lambda i: array_to_string(list_slice(w, i + 1, i + 3), ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP7 = rf"""
WITH b AS (SELECT item_id, coalesce(regexp_extract_all({_LOW}, {_ALNUM}), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m,
        unnest(list_transform(range(0, len(w) - least(10, len(w)) + 1), lambda i: array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' '))) AS g FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_ALNUM}), []) AS w FROM documents),
x AS (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, x.m, item_id FROM x JOIN win ON win.m = x.m AND win.g = array_to_string(list_slice(w, i + 1, i + x.m), ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_SPACE})), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'none')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s0),
s2 AS (SELECT *, [5, 2, 1][pos % 3 + 1]::BIGINT AS w, 3 * ss AS cap FROM s1),
s3 AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
       (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w::DOUBLE, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rw FROM s2),
s4 AS (SELECT *, cap * rw <= w * rest AS filled FROM s3),
lv AS (SELECT arg_min(rest, cap / w::DOUBLE) AS lr, arg_min(rw, cap / w::DOUBLE) AS lw FROM s4 WHERE NOT filled),
t AS (SELECT source, pos, ss, CASE WHEN filled THEN cap::DOUBLE ELSE (w * lr)::DOUBLE / lw END AS target FROM s4, lv),
k AS (SELECT greatest(16, least(1024, sum(ss) // greatest(1, count(*) * 1024)))::BIGINT AS words FROM t),
bl AS (SELECT t.*, greatest(1, least(words, floor(target / 64)::BIGINT))::BIGINT AS words FROM t, k),
du AS (SELECT *, target / words AS due FROM bl),
cu AS (SELECT pos, sum(due) OVER (ORDER BY pos) AS upto, pos = max(pos) OVER () AS last FROM du WHERE target > 0),
iv AS (SELECT pos, coalesce(lag(upto) OVER (ORDER BY pos), 0) / max(upto) OVER () AS lo, upto / max(upto) OVER () AS hi, last FROM cu),
pt AS (SELECT i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS x FROM (SELECT unnest(range(0, sum(ceil(due))::BIGINT)) AS i FROM du)),
n AS (SELECT pos, count(*) AS slots FROM pt JOIN iv ON x >= lo AND (x < hi OR last) GROUP BY pos),
o AS (SELECT d.*, ss, target, coalesce(slots, 0) * words AS got,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN du ON d.source IS NOT DISTINCT FROM du.source LEFT JOIN n ON n.pos = du.pos)
SELECT doc_id, size, source, ss AS source_size, target,
       (least(size, greatest(0, got - start)) + least(size, greatest(0, got - ss - start)) + least(size, greatest(0, got - 2 * ss - start)))::BIGINT AS taken FROM o"""




def op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out, a common table for each."""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
    ctes = ["""e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
     WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
            f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e ORDER BY h LIMIT {k}))"""]
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, v, k, {far} AS d FROM e, c{i}) GROUP BY vec_id, v)"
    for i in range(rounds):
        ctes += [near(i), f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN
     (SELECT k, list({mean} ORDER BY i) AS c FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY k, i) GROUP BY k) m USING (k))"""]
    ctes.append(near(rounds))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


OP13 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
     WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_lsm": OP2, "op6_minhash_circulant": OP6, "op7_decontaminate": OP7, "op10_source_mix": OP10, "op12_dual_tree_lloyd": op12_sql(),
            "op13_branch_bound_topk": OP13}
