"""Record linkage: dictionary building, id expansion into clusters, pairs, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import LABELS, normal_label
from textloom.operators.staging import staged
from textloom.session import ship

# Vocabularies through which ids expand, and the sources of each language by tier.
VOCABULARIES = ("ICD-10CM", "ICD-10", "MeSH", "DOID", "Pschyrembel")
DE_SOURCES, EN_SOURCES = ("msd", "gesund", "apoum"), ("msd", "nhs")
FLIPPED = {"spezialisierung": "generalisierung", "generalisierung": "spezialisierung"}


def flattened_synonyms(df: DataFrame, key: str, title: str, synonyms: str, sep: str = ";") -> DataFrame:
    """One row a title or synonym; the first of equal (key, title) stays, originals before synonyms."""
    own = df.select(key, F.col(title).alias("title"), F.lit(0).alias("_o"))
    syn = df.select(key, F.explode(F.split(synonyms, sep)).alias("title"), F.col(title).alias("_t")).withColumn("title", F.trim("title")).where("title <> '' and title <> _t")
    every = own.unionAll(syn.select(key, "title", F.lit(1).alias("_o")))
    return every.groupBy(key, "title").agg(F.min("_o").alias("is_synonym"))


def joined_sets(df: DataFrame, key: str, columns: list[str], sep: str = "; ") -> DataFrame:
    return df.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(c)), sep).alias(c) for c in columns))


def descriptor_terms(df: DataFrame, key: str, term: str, permuted: str, columns: list[str]) -> DataFrame:
    """Terms that are not permuted or hold no inversion, gathered per descriptor."""
    return joined_sets(df.where((F.col(permuted) == "N") | ~F.contains(F.col(term), F.lit(", "))), key, columns)


def reverse_index(records: DataFrame) -> DataFrame:
    """``vocab, value, source, instance`` of records with a map of id lists; unknown vocabularies are left out."""
    ids = records.select("source", "instance", F.explode("external_ids").alias("vocab", "ids")).where(F.col("vocab").isin(*VOCABULARIES, "MSD"))
    return ids.select("vocab", F.explode_outer("ids.value").alias("value"), "source", "instance").where("value is not null").distinct()


def expand_two_hops(index: DataFrame, seeds: DataFrame | None = None, sources: tuple[str, ...] | None = None) -> DataFrame:
    """``vocab, value, source, instance``: articles of a seed id, and those of the other ids of these articles."""
    reach = index if sources is None else index.where(F.col("source").isin(*sources))
    seed = (index if seeds is None else seeds).select("vocab", "value").distinct()
    one = seed.join(reach, ["vocab", "value"])
    more = one.select(F.col("vocab").alias("v0"), F.col("value").alias("x0"), "source", "instance").join(index, ["source", "instance"]).select("v0", "x0", "vocab", "value").distinct()
    two = more.join(reach, ["vocab", "value"]).select(F.col("v0").alias("vocab"), F.col("x0").alias("value"), "source", "instance")
    return one.select("vocab", "value", "source", "instance").unionAll(two).distinct()


def expand_by_instance(index: DataFrame) -> DataFrame:
    """Articles of other sources that share an id: ``source, instance, other_source, other``."""
    b = index.withColumnsRenamed({"source": "other_source", "instance": "other"})
    return index.join(b, ["vocab", "value"]).where("source <> other_source").select("source", "instance", "other_source", "other").distinct()


def merged_down(members: DataFrame, cluster: list[str]) -> DataFrame:
    """Per article: all articles of the clusters that hold it."""
    other = members.withColumnsRenamed({"source": "other_source", "instance": "other"})
    return members.join(other, cluster).select("source", "instance", "other_source", "other").distinct()


def tiers(clusters: DataFrame) -> DataFrame:
    """Clusters without a base article are dropped. German: two, plus one for each further source; English: two plus one."""
    has = lambda s: F.max((F.col("source") == s).cast("int"))
    by = clusters.groupBy("language", "cluster_id").agg(has("msd").alias("_m"), has("gesund").alias("_g"), has("apoum").alias("_a"), has("nhs").alias("_n")).where("_m = 1")
    t = F.when(F.col("language") == "de", 2 + F.col("_g") + F.col("_a")).otherwise(2 + F.col("_n"))
    return by.select("language", "cluster_id", t.alias("tier"))


def bilingual(tiered: DataFrame) -> DataFrame:
    """Clusters in the German tier 4 and the English tier 3."""
    return tiered.where("language = 'de' and tier = 4").select("cluster_id").join(tiered.where("language = 'en' and tier = 3").select("cluster_id"), "cluster_id", "left_semi")


def cluster_pairs(atoms: DataFrame) -> DataFrame:
    """Unordered pairs of distinct atoms of a cluster, once over all clusters. ``atoms``: language, cluster_id, tier, source, id."""
    a = atoms.dropDuplicates(["language", "cluster_id", "source", "id"])
    b = a.select("language", "cluster_id", F.col("source").alias("source_b"), F.col("id").alias("id_b"))
    j = a.withColumnsRenamed({"source": "source_a", "id": "id_a"}).join(b, ["language", "cluster_id"]).where("struct(source_a, id_a) < struct(source_b, id_b)")
    return j.groupBy("language", "source_a", "id_a", "source_b", "id_b").agg(F.array_join(F.transform(F.array_sort(F.collect_set("cluster_id")), lambda c: c.cast("string")), ",").alias("cluster_ids"), F.max("tier").alias("max_tier"))


def title_key(a: str = "title_a", b: str = "title_b") -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "\x1f")


def duplicate_pairs(pairs: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent unordered title pairs."""
    return pairs.groupBy(title_key().alias("title_pair")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "title_pair").limit(top)


def filtered_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Without pairs that gold holds by title, without English twins of German id pairs, first of equal title pairs."""
    p = pairs.withColumn("_t", title_key())
    p = p.join(gold.select(F.array_join(F.array_sort(F.array(F.trim("title_a"), F.trim("title_b"))), "\x1f").alias("_t")).distinct(), "_t", "left_anti")
    ids = ["source_a", "id_a", "source_b", "id_b"]
    p = p.where("language <> 'en'").unionByName(p.where("language = 'en'").join(p.where("language = 'de'").select(*ids).distinct(), ids, "left_anti"))
    first = F.row_number().over(Window.partitionBy("_t").orderBy("language", *ids))
    return p.withColumn("_r", first).where("_r = 1").drop("_r", "_t")


def bilingual_id_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source_a", "id_a", "source_b", "id_b").agg(F.countDistinct("language").alias("n_languages")).where("n_languages > 1")


def confusion(results: DataFrame) -> DataFrame:
    """Per gold label, with a row for all: number, right ones, accuracy."""
    ok = F.count_if(F.col("gold") == F.col("pred"))
    return results.rollup("gold").agg(F.count("*").alias("n"), ok.alias("n_right"), (ok / F.count("*")).alias("accuracy"))


def article_titles(views: DataFrame, priority: list[str]) -> DataFrame:
    """One title an article and language, from the first subtree that has text. ``views``: source, id, language, subtree, title, text."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("subtree"))
    w = Window.partitionBy("source", "id", "language").orderBy(F.when(rank > 0, rank).otherwise(len(priority) + 1), "subtree")
    return views.where("length(trim(text)) > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("source", "id", "language", "title")


def site_pairs(views: DataFrame) -> DataFrame:
    """All pairs of distinct views of an article."""
    v = views.where("length(trim(text)) > 0").select("source", "id", F.concat_ws("/", "language", "subtree").alias("view")).distinct()
    return v.withColumnRenamed("view", "view_a").join(v.withColumnRenamed("view", "view_b"), ["source", "id"]).where("view_a < view_b").withColumn("label", F.lit("richtig"))


def title_expand(pairs: DataFrame, index: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Title pairs to node pairs: every node of either title, no self pairs. ``index`` and ``overrides``: title, node.

    Overrides hold for a source too where they have a column ``source``, as then ``pairs`` has ``source_a`` and
    ``source_b``: they replace what the index says of that title in that source; a null node skips the title.
    """
    idx = index.select("title", "node").distinct()
    out = pairs
    for x in "ab":
        if overrides is None:
            out = out.join(idx.withColumnsRenamed({"title": f"title_{x}", "node": x}), f"title_{x}")
            continue
        by = [f"title_{x}"] + ([f"source_{x}"] if "source" in overrides.columns else [])
        o = overrides.withColumnsRenamed({"title": f"title_{x}", "source": f"source_{x}"}).select(*by, F.col("node").alias(x)).distinct()
        known = out.join(o.select(*by).distinct(), by, "left_semi").join(o.where(F.col(x).isNotNull()), by)
        other = out.join(o.select(*by).distinct(), by, "left_anti").join(idx.withColumnsRenamed({"title": f"title_{x}", "node": x}), f"title_{x}")
        out = known.unionByName(other)
    return out.where("a <> b")


def node_pairs(pairs: DataFrame, index: DataFrame, block: int = 256) -> DataFrame:
    """Distinct ``a, b`` of ``title_expand`` without overrides, for titles of many nodes.

    The nodes of a title are dealt into blocks, blocks meet by title, and rows of two blocks are dealt out anew before
    they become pairs: a title of many nodes does not make one task large. Two titles give a pair of nodes once, so only
    pairs with a node of several titles are compared.
    """
    idx = index.select("title", "node").distinct().where("node is not null")
    several = idx.groupBy("node").agg((F.count("*") > 1).alias("several"))
    sized = idx.join(idx.groupBy("title").agg(F.count("*").alias("_c")), "title").join(several, "node")
    deal = F.pmod(F.xxhash64("node"), F.ceil(F.col("_c") / block)).alias("_b")
    blocks = sized.groupBy("title", "several", deal).agg(F.collect_list("node").alias("nodes")).drop("_b")
    side = lambda x: blocks.withColumnsRenamed({"title": f"title_{x}", "several": f"several_{x}", "nodes": f"nodes_{x}"})
    met = pairs.select("title_a", "title_b").distinct().join(side("a"), "title_a").join(side("b"), "title_b").drop("title_a", "title_b")
    met = staged(met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    made = lambda m: m.select(F.explode("nodes_a").alias("a"), "nodes_b").select("a", F.explode("nodes_b").alias("b")).where("a <> b")
    return made(met.where("not several_a and not several_b")).unionByName(made(met.where("several_a or several_b")).distinct())


def unresolved(pairs: DataFrame, index: DataFrame) -> DataFrame:
    one = lambda x: pairs.select(F.lit(x).alias("side"), F.col(f"title_{x}").alias("title"), "label").join(index.select("title").distinct(), "title", "left_anti")
    return one("a").unionByName(one("b"))


def canonical(edges: DataFrame, keep_wrong: bool = False) -> DataFrame:
    """Endpoints in order, flipping directed labels and views with them; each edge once."""
    swap, label = F.col("a") > F.col("b"), normal_label(F.col("label"))
    flipped = label
    for k, v in FLIPPED.items():
        flipped = F.when(label == k, v).otherwise(flipped)
    out = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, flipped).otherwise(label).alias("label"), "judge", "model",
                       F.when(swap, F.col("b_view")).otherwise(F.col("a_view")).alias("a_view"), F.when(swap, F.col("a_view")).otherwise(F.col("b_view")).alias("b_view"))
    return (out if keep_wrong else out.where("label <> 'falsch'")).distinct()


def partner_tiers(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per tier: articles by the number of other tiers that they are aligned with. ``membership``: node, tier."""
    both = edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    m = membership.distinct()
    j = both.join(m.withColumnsRenamed({"node": "a", "tier": "ta"}), "a").join(m.withColumnsRenamed({"node": "b", "tier": "tb"}), "b").where("ta <> tb")
    k = j.groupBy(F.col("a").alias("node"), F.col("ta").alias("tier")).agg(F.countDistinct("tb").alias("k"))
    return m.join(k, ["node", "tier"], "left").groupBy("tier", F.coalesce("k", F.lit(0)).alias("n_partners")).agg(F.count("*").alias("n"))


def best_bucket(members: DataFrame, corpus: DataFrame, order: list[str], max_words: int, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """Each article once, in its best bucket, if it has text of at most so many words. ``members``: keys and bucket."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("bucket"))
    best = members.where(rank > 0).groupBy(*keys).agg(F.min(rank).alias("priority"))
    out = best.join(corpus, list(keys)).where((F.col("n_words") > 0) & (F.col("n_words") <= max_words))
    return out.withColumn("bucket", F.element_at(F.array(*map(F.lit, order)), F.col("priority").cast("int")))


def stratified(items: DataFrame, groups: tuple[str, ...] = ("source",), key: str = "id", seed: int = 42) -> DataFrame:
    """Order by bucket, then in turn from each group, shuffled by a seeded hash: adds ``turn``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return items.withColumn("turn", F.row_number().over(Window.partitionBy("priority", *groups).orderBy(h, key)))


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has left."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def rule_judge(pairs: DataFrame) -> DataFrame:
    """The default judge: equal titles are right, a title inside the other is a direction, others are wrong."""
    a, b = F.lower(F.trim("title_a")), F.lower(F.trim("title_b"))
    return pairs.withColumn("pred", F.when(a == b, "richtig").when(F.contains(a, b), "spezialisierung").when(F.contains(b, a), "generalisierung").otherwise("falsch"))


# ---- dictionaries ---------------------------------------------------------------------------------

def other_names(terms: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("descriptor_ui", "concept_ui"), order: str = "pos") -> DataFrame:
    """Adds the name that another language's table has for each key, the last one winning: ``<key>_other``."""
    out = terms
    for k in keys:
        name = k.replace("_ui", "_name")
        out = out.join(other.groupBy(k).agg(F.max_by(name, order).alias(f"{name}_other")), k, "left")
    return out


def link_table(nodes: DataFrame, key: str, links: str) -> DataFrame:
    """Distinct links of each node."""
    return nodes.select(key, F.explode(links).alias("url")).distinct()


def translations(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Names in the other language, without inversions (a comma and a blank), once for each key."""
    return rows.where(F.col(name).isNotNull() & ~F.contains(F.col(name), F.lit(", "))).select(key, name).distinct()


def dictionary_metadata(rows: DataFrame, icd: str, fields: list[str]) -> DataFrame:
    """Adds ``metadata``: the fields as JSON, with the code in lower case as ``icd10``."""
    return rows.withColumn("metadata", F.to_json(F.struct(*fields, F.lower(icd).alias("icd10"))))


# ---- clusters as tables -----------------------------------------------------------------------------

def merged_rows(members: DataFrame, key: str, numeric: tuple[str, ...] = ("gesund", "apoum")) -> DataFrame:
    """Rows of equal joined ids become one: ``key`` and, for each source, its ids and titles joined by "; ".

    ``members``: key, row, source, id, title. Ids sort as numbers in the numeric sources, titles follow their ids.
    """
    place = F.when(F.col("source").isin(*numeric), F.expr("lpad(id, 20, '0')")).otherwise(F.col("id"))
    own = members.where(F.col("source") == F.lit(key)).groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("p"), "id"))), lambda x: x["id"]), "; ").alias("ids"))
    every = members.join(own, "row").select("ids", "source", place.alias("p"), "id", "title").distinct()
    got = every.groupBy("ids", "source").agg(F.array_sort(F.collect_list(F.struct("p", "id", "title"))).alias("x"))
    joined = lambda f: F.array_join(F.array_distinct(F.transform("x", lambda v: v[f])), "; ")
    return got.select("ids", "source", joined("id").alias("id"), joined("title").alias("title"))


def linked_distances(edges: DataFrame, vectors: DataFrame, distance) -> DataFrame:
    """Least distance between each article and each it is linked with in other sources: ``a, b, distance``.

    ``vectors``: node, embedding; a node may have several (languages). Articles without a vector are left out.
    """
    va, vb = (vectors.select(F.col("node").alias(x), F.col("embedding").alias(f"v{x}")) for x in "ab")
    j = edges.select("a", "b").distinct().join(va, "a").join(vb, "b")
    return j.groupBy("a", "b").agg(F.min(distance(F.col("va"), F.col("vb"))).alias("distance"))


# ---- pairs: counts, gold, judging -----------------------------------------------------------------------

def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs by language, by (language, sources) and by tier, in one pass: nulls mark what a row sums over."""
    c = pairs.groupingSets([["language"], ["language", "source_a", "source_b"], ["max_tier"]], "language", "source_a", "source_b", "max_tier")
    return c.agg(F.count("*").alias("n"))


def gold_title_pairs(rows: DataFrame, target: str = "apoum_title", sources: tuple[str, ...] = ("MSD_title", "gesund_title", "NHS_title"), *keep: str) -> DataFrame:
    """Distinct pairs of a source title and a target title, both stripped and not empty, of lists parted by ";"."""
    parts = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    lists = F.flatten(F.array(*(F.coalesce(parts(F.col(c)), F.array().cast("array<string>")) for c in sources)))
    return rows.select(*keep, F.explode(parts(F.col(target))).alias("target"), lists.alias("_s")).select(*keep, F.explode("_s").alias("source"), "target").distinct()


def eval_pairs(rows: DataFrame, raw: DataFrame | None = None, comment: str = "comments", order: str = "row") -> DataFrame:
    """Labelled pairs, the last label of a pair winning; pairs that only the raw table has are wrong.

    Only the three spellings of the sheet are normalised, so others stay as they are.
    """
    spelled = F.col(comment)
    for k, v in (("False", "falsch"), ("richtig_1", "richtig"), ("richtig_2", "richtig")):
        spelled = F.when(F.col(comment) == k, v).otherwise(spelled)
    got = gold_title_pairs(rows.withColumn("label", spelled).where("label is not null"), "apoum_title", ("MSD_title", "gesund_title", "NHS_title"), order, "label")
    gold = got.groupBy("source", "target").agg(F.max_by("label", order).alias("label"))
    if raw is None:
        return gold
    rest = gold_title_pairs(raw).join(gold, ["source", "target"], "left_anti").withColumn("label", F.lit("falsch"))
    return gold.unionByName(rest)


def judged(pairs: DataFrame, provider, labels: tuple[str, ...] = LABELS, tries: int = 4, wait: float = 1.0, batch: int = 32) -> DataFrame:
    """Adds ``pred``, ``attempts``, ``prompt_tokens``, ``cached_tokens`` and ``completion_tokens`` by a judge.

    ``provider(title_a, title_b)`` returns (answer, usage dict). An answer that is no label, or an error, is tried again
    after ``wait`` times 1, 2, 4 ... seconds; the last failure stops the task, which Spark then runs anew.
    """
    def run(batches):
        import time

        import pandas as pd
        for pdf in batches:
            out = []
            for a, b in zip(pdf["title_a"], pdf["title_b"]):
                for i in range(tries + 1):
                    try:
                        answer, usage = provider(a, b)
                        if answer not in labels:
                            raise ValueError(f"no label: {answer!r}")
                        break
                    except Exception:
                        if i == tries:
                            raise
                        time.sleep(wait * 2 ** i)
                out.append((answer, i + 1, *(int(usage.get(k, 0)) for k in ("prompt_tokens", "cached_tokens", "completion_tokens"))))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["pred", "attempts", "prompt_tokens", "cached_tokens", "completion_tokens"])], axis=1)

    ship(pairs.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(run, f"{schema}, pred string, attempts long, prompt_tokens long, cached_tokens long, completion_tokens long")


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Counters of a judge's calls: requests, tokens, and the share of prompt tokens that were cached."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.groupBy(*by).agg(F.count("*").alias("requests"), *(total(c).alias(c) for c in ("prompt_tokens", "cached_tokens", "completion_tokens")),
                                  F.coalesce(F.try_divide(total("cached_tokens").cast("double"), total("prompt_tokens")), F.lit(0.0)).alias("cache_hit_rate"))


def judge_run(pairs: DataFrame, done: DataFrame | None, provider, path: str, keys: list[str]) -> DataFrame:
    """Judges what a resumed run has left and appends full and slim rows to ``path``, which become visible together.

    Answers are written once before the commit, so that both tables hold the same ones. Returns all full rows.
    """
    from textloom.operators.staging import staged
    from textloom.sources.sinks import Ledger, append_all, appended
    spark = pairs.sparkSession
    rest = pairs if done is None else remaining(pairs, done, keys)
    if Ledger(spark, path).batches():
        rest = remaining(rest, appended(spark, path, "full"), keys)
    full = staged(judged(rest, provider))
    append_all({"full": full, "slim": full.select(*keys, "pred")}, path, keys)
    return appended(spark, path, "full")


def evaluated(gold: DataFrame, provider, limit: int | None = None, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judgments of gold pairs (source, target, label) and their report; ``hard`` keeps the wrong ones alone in the first."""
    rows = gold.select(F.col("source").alias("title_a"), F.col("target").alias("title_b"), F.col("label").alias("gold"))
    rows = rows if limit is None else rows.orderBy("title_a", "title_b").limit(limit)
    got = judged(rows, provider)
    return (got.where("gold <> pred") if hard else got), confusion(got)
