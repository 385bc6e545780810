"""Significance tables over aligned articles: steps of a chain of sources, families of tests, markers, grids.

Long tables throughout: one row a cell (language, metric, step). Chains of sources and the metrics' registry are small
configuration, given as lists or as one-row-a-metric tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import sig_marker
from textloom.operators import stats

# Chains from hard to easy, the tier of each view, and labels of sources.
CHAINS = {"de": ("msd_expert", "msd_lay", "gesund", "apoum"), "en": ("msd_expert", "msd_lay", "gesund", "nhs")}
TIERS = {("msd", "professional"): "msd_expert", ("msd", "amateur"): "msd_lay", ("gesund", "amateur"): "gesund", ("apoum", "amateur"): "apoum", ("nhs", "amateur"): "nhs"}
TIER_NODES, VIEWS = {"msd_expert": "msd", "msd_lay": "msd"}, {"msd_expert": "professional", "msd_lay": "amateur"}
LABELS, JUDGES = ("richtig", "spezialisierung", "generalisierung"), ("human", "llm", "site")
SOURCE_LABELS = {"apoum": "Apotheken\nUmschau", "nhs": "NHS", "gesund": "gesund.\nbund", "msd_short": "MSD Manual\n(Quick Facts)",
                 "msd_lay": "MSD\nConsumer", "msd_expert": "MSD Manual\n(Professional)"}
WRONG_COLOUR = "#D55E00"


def adjacent(chain: Sequence[str]) -> list[tuple[str, str]]:
    return list(zip(chain[:-1], chain[1:]))


def node_source(source: str) -> str:
    """The source of a view's articles: msd_expert and msd_lay are two views of one."""
    return TIER_NODES.get(source, source)


def step_pairs(edges: DataFrame, chain: Sequence[str], language: str = "de") -> DataFrame:
    """``sa, sb, a, b``: edges of each step, turned to it, once each. ``edges``: a, b, source_a, source_b, a_view, b_view.

    A step between two views of one source needs the same article on both sides and the views of this language, in either
    order. Other steps ask for their two sources alone, in either order, whatever the language and the views.
    """
    def match(sa: str, sb: str) -> Column:
        x, y = node_source(sa), node_source(sb)
        turned = lambda a, b: F.struct(F.lit(sa).alias("sa"), F.lit(sb).alias("sb"), F.col(a).alias("a"), F.col(b).alias("b"))
        ahead, back = (F.col("source_a") == x) & (F.col("source_b") == y), (F.col("source_a") == y) & (F.col("source_b") == x)
        if x == y:
            va, vb = (f"{language}_{VIEWS[s]}" for s in (sa, sb))
            same = ahead & (F.col("a") == F.col("b"))
            ahead, back = same & (F.col("a_view") == va) & (F.col("b_view") == vb), same & (F.col("a_view") == vb) & (F.col("b_view") == va)
        return F.when(ahead, turned("a", "b")).when(back, turned("b", "a"))

    found = F.explode(F.array_compact(F.array(*(match(*s) for s in adjacent(chain))))).alias("s")
    return edges.select(found).select("s.*").distinct()


def aligned_significance(edges: DataFrame, values: DataFrame, registry: DataFrame, language: str, labels: Sequence[str], judges: Sequence[str],
                         how: str = "holm", alpha: float = 0.05) -> DataFrame:
    """From aligned values to marked cells, one plan: ``language, metric, expected, pos, sa, sb, n_pairs, n_values, delta,
    p, right, sig, marker, emphasis``.

    ``edges``: as for ``step_pairs``, with label and judge, of which the given ones count; ``values``: metric, source (a view
    of the chain), id, value; ``registry``: metric, expected, the whole family of the correction. Cells of metrics without
    expectation are left out; cells without a p-value stay, unmarked, and leave their metric without emphasis.
    """
    for given, known, name in ((labels, LABELS, "label"), (judges, JUDGES, "judge")):
        if unknown := set(given) - set(known):
            raise ValueError(f"unknown {name}: {sorted(unknown)}")
    chain = CHAINS[language]
    pairs = step_pairs(edges.where(F.col("label").isin(*labels) & F.col("judge").isin(*judges)), chain, language)
    stat = cells(registry.where("expected <> 0"), chain, pairs, values)
    tested = stats.with_p(stat, alternative(F.col("expected"))).withColumn("language", F.lit(language))
    sig = significance_markers(significance_cells(tested, ("language",), how, alpha))
    out = sig.join(label_emphasis(sig, len(chain) - 1), ["language", "metric"])
    return out.select("language", "metric", "expected", "pos", "sa", "sb", "n_pairs", "n_values", "delta", "p", "right", "sig", "marker", "emphasis")


def cells(metrics: DataFrame, chain: Sequence[str], pairs: DataFrame, values: DataFrame, sign: Column | None = None) -> DataFrame:
    """Statistics of every metric and step: n_pairs, n, median, rank sums. ``metrics``: metric, expected; ``values``:
    metric, source, id, value. ``sign`` scales value(b) - value(a). Steps without data have n 0 and nulls."""
    steps = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(a).alias("sa"), F.lit(b).alias("sb")) for i, (a, b) in enumerate(adjacent(chain))))
    grid = metrics.select("metric", "expected", F.explode(steps).alias("s")).select("metric", "expected", "s.*")
    va = values.select("metric", F.col("source").alias("sa"), F.col("id").alias("a"), F.col("value").alias("va"))
    vb = values.select("metric", F.col("source").alias("sb"), F.col("id").alias("b"), F.col("value").alias("vb"))
    d = pairs.join(va, ["sa", "a"]).join(vb, ["metric", "sb", "b"]).join(F.broadcast(metrics.select("metric", "expected")), "metric")
    d = d.withColumn("delta", (F.col("vb") - F.col("va")) * (sign if sign is not None else F.lit(1)))
    got = stats.signed_ranks(d, ["metric", "sa", "sb"])
    available = pairs.groupBy("sa", "sb").agg(F.count("*").alias("n_pairs"))
    out = grid.join(got, ["metric", "sa", "sb"], "left").join(available, ["sa", "sb"], "left")
    return out.withColumns({"n_pairs": F.coalesce("n_pairs", F.lit(0)), "n_values": F.coalesce("n_all", F.lit(0)), "delta": F.col("median_delta")}).drop("n_all", "median_delta")


def alternative(expected: Column, one_sided: bool = True) -> Column:
    return F.when(F.lit(one_sided) & (expected > 0), "greater").when(F.lit(one_sided) & (expected < 0), "less").otherwise("two-sided")


def direction_table(stat: DataFrame, alpha: float = 0.05, one_sided: bool = True) -> DataFrame:
    """``cells`` with p, markers of both directions and the metric's verdict, long."""
    t = stats.with_p(stat, alternative(F.col("expected"), one_sided)).withColumns({"alternative": alternative(F.col("expected"), one_sided)})
    t = t.withColumns({"sig": sig_marker(F.col("p")), "wrong_sig": stats.wrong_marker(F.col("delta"), F.col("p"), F.col("expected"), one_sided)})
    return t.join(stats.grade(t.withColumn("shift", F.col("delta")), ["metric"], alpha, one_sided), "metric")


def direction_wide(table: DataFrame, columns: Sequence[str] = ("delta", "p", "sig", "n")) -> DataFrame:
    """One row a metric, the steps as columns."""
    label = F.concat(F.col("sa"), F.lit("->"), F.col("sb"))
    return table.withColumn("step", label).groupBy("metric", "expected", "verdict").pivot("step").agg(*(F.first(c).alias(c) for c in columns))


def family_metrics(registry: DataFrame, language: str, extra: Sequence[str] = ()) -> DataFrame:
    """All metrics of a language's grid, whatever a table shows, and the extra ones named. ``registry``: metric, grids."""
    own = registry.where(F.array_contains("grids", language))
    return own if not extra else own.unionByName(registry.where(F.col("metric").isin(*extra) & ~F.array_contains("grids", language)))


def grid_covers(registry: DataFrame, shown: str, language: str) -> DataFrame:
    """Metrics that a table shows and the language's grid lacks: none in a sound registry."""
    return registry.where(F.col(shown) & ~F.array_contains("grids", language)).select("metric")


def significance_cells(tested: DataFrame, family: Sequence[str] = ("language",), how: str = "holm", alpha: float = 0.05) -> DataFrame:
    """``right`` and ``sig`` of each cell, corrected over its whole family.

    ``tested``: family columns, metric, expected, step, delta, and p of the one-sided test towards the expected
    direction. Cells of the wrong direction enter with 1 - p. Metrics without expectation are left out; cells without p stay, unmarked.
    """
    t = tested.where("expected <> 0").withColumn("right", F.coalesce(stats.right_direction(F.col("delta"), F.col("expected")), F.lit(False)))
    t = t.withColumns({"p_given": F.col("p"), "p": F.when(F.col("right"), F.col("p")).otherwise(1 - F.col("p"))})
    return stats.rejected(t, list(family), how, alpha).withColumnsRenamed({"reject": "sig"}).withColumn("p_toward", F.col("p")).withColumn("p", F.col("p_given")).drop("p_given")


def significance_markers(sig: DataFrame, dagger: str = "\\textdagger") -> DataFrame:
    """``*`` for a significant step in the right direction, a dagger in the wrong one, at the step's harder source."""
    mark = F.when(F.col("sig") & F.col("right"), "*").when(F.col("sig"), dagger).otherwise("")
    return sig.withColumn("marker", mark)


def label_emphasis(sig: DataFrame, n_steps: int, keys: Sequence[str] = ("language", "metric")) -> DataFrame:
    """bold: all steps right and significant; underline: some, none significant the wrong way; else nothing."""
    good = F.count_if(F.col("right") & F.col("sig"))
    c = sig.groupBy(*keys).agg(good.alias("_g"), F.count_if(~F.col("right") & F.col("sig")).alias("_w"), F.count("p").alias("_n"))
    e = F.when((F.col("_w") > 0) | (F.col("_g") == 0) | (F.col("_n") < n_steps), "").when(F.col("_g") == n_steps, "bold").otherwise("underline")
    return c.select(*keys, e.alias("emphasis"))


def brackets(sig: DataFrame, keys: Sequence[str] = ("language", "metric"), order: str = "pos") -> DataFrame:
    """Significant steps with their height in the stack, mark and colour."""
    from pyspark.sql import Window
    level = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return sig.where("sig").withColumns({"level": level, "mark": F.when(F.col("right"), "*").otherwise("†"), "colour": F.when(F.col("right"), "black").otherwise(WRONG_COLOUR)})


def source_dependence(metrics: DataFrame, chain: Sequence[str], pairs: DataFrame, simplified: DataFrame) -> DataFrame:
    """Whether rewritten texts still differ by source: -expected * (hard - easy) is expected above 0; p is one-sided.

    Metrics without expectation are left out.
    """
    some = metrics.where("expected <> 0")
    stat = cells(some, chain, pairs, simplified, F.col("expected"))
    return stats.with_p(stat, "greater").withColumn("sig", sig_marker(F.col("p")))


def bleed_cells(quads: DataFrame, keys: Sequence[str], n_steps: int, alpha: float = 0.05) -> DataFrame:
    """Stars and share of the original gap left per metric, over steps with a defined p.

    ``quads``: keys, step, d_orig, d_simp of pairs that have all four values, both oriented hard to easy.
    """
    k = [*keys, "step"]
    stat = stats.with_p(stats.signed_ranks(quads, k, "d_simp"), "greater").where("p is not null")
    return bleed_report(stat.join(stats.quantiles(quads, k, "d_orig", orig=0.5).drop("n"), k).withColumnRenamed("median_delta", "simp"), keys, n_steps, alpha)


def bleed_report(steps: DataFrame, keys: Sequence[str], n_steps: int, alpha: float = 0.05) -> DataFrame:
    """The same from steps with their medians ``orig`` and ``simp`` and ``p``."""
    right = F.col("simp") > 0
    per = steps.groupBy(*keys).agg(F.count_if(right & (F.col("p") < alpha)).alias("_r"), F.count_if(~right & (1 - F.col("p") < alpha)).alias("_w"), F.count("*").alias("_n"),
                                   (100 * F.try_divide(F.avg("simp"), F.avg("orig"))).alias("bleed_pct"))
    stars = F.when((F.col("_w") > 0) | (F.col("_n") < n_steps), "").otherwise(F.expr("repeat('*', cast(_r as int))"))
    return per.select(*keys, stars.alias("stars"), "bleed_pct")


def bleed_grid(report: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Metrics by language, limited to those confirmed there; one confirmed in either language has a row."""
    got = confirmed.join(report, ["metric", "language"], "left")
    return got.groupBy("metric").pivot("language", ["de", "en"]).agg(F.first("stars").alias("stars"), F.first("bleed_pct").alias("bleed_pct"))


def tier_membership(records: DataFrame) -> DataFrame:
    """``language, tier, node``: distinct articles of each tier; views outside the chain have none. ``records``: source,
    subtree, language, article_id."""
    from textloom.functions.text import short_id
    tier = F.lit(None).cast("string")
    for (source, subtree), name in TIERS.items():
        tier = F.when((F.col("source") == source) & (F.col("subtree") == subtree), name).otherwise(tier)
    rows = records.where("article_id is not null and article_id <> ''").withColumn("tier", tier).where("tier is not null")
    return rows.select("language", "tier", F.concat(F.col("source"), F.lit(":"), short_id(F.col("source"), F.col("article_id"))).alias("node")).distinct()


def node_tiers(membership: DataFrame) -> DataFrame:
    """Tiers of each article in each language, by name."""
    return membership.groupBy("language", "node").agg(F.array_sort(F.collect_set("tier")).alias("tiers"))


def labelled(df: DataFrame, source: str = "source", labels: dict[str, str] | None = None) -> DataFrame:
    """Adds ``label`` of a source; unknown sources keep their name."""
    out = F.col(source)
    for k, v in (labels or SOURCE_LABELS).items():
        out = F.when(F.col(source) == k, v).otherwise(out)
    return df.withColumn("label", out)


def titled(df: DataFrame, registry: DataFrame, language: str) -> DataFrame:
    """Adds a metric's title in a language."""
    return df.join(registry.select("metric", F.col(f"title_{language}").alias("title")), "metric", "left")
