"""Paired statistics over aligned values: signed ranks, corrections for many tests, effect sizes, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import sig_marker
from textloom.operators.staging import staged


def clean_values(df: DataFrame, column: str, ids: str, order: str) -> DataFrame:
    """Numeric values by id: -1, NaN and non-numbers are dropped, the last of equal ids stays."""
    v = F.expr(f"try_cast({column} as double)")
    ok = df.withColumn("_v", v).where("_v is not null and not isnan(_v) and _v <> -1")
    return ok.groupBy(ids).agg(F.max_by("_v", order).alias("value"))


def adjacent_steps(chain: DataFrame) -> DataFrame:
    """``language, pos, source, next``: neighbours in the ordered chain of sources."""
    return chain.withColumn("next", F.lead("source").over(Window.partitionBy("language").orderBy("pos"))).where("next is not null")


def oriented_pairs(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges of each step, turned so that a belongs to the step's first source. ``edges``: a, b, source_a, source_b."""
    s = steps.select(F.col("source").alias("sa"), F.col("next").alias("sb")).distinct()
    one = edges.join(s, (F.col("source_a") == F.col("sa")) & (F.col("source_b") == F.col("sb"))).select("sa", "sb", "a", "b")
    two = edges.join(s, (F.col("source_b") == F.col("sa")) & (F.col("source_a") == F.col("sb"))).select("sa", "sb", F.col("b").alias("a"), F.col("a").alias("b"))
    return one.unionByName(two).distinct()


def deltas(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Adds va, vb and delta; ``values``: id, value."""
    return pairs.join(values.withColumnsRenamed({"id": "a", "value": "va"}), "a").join(values.withColumnsRenamed({"id": "b", "value": "vb"}), "b").withColumn("delta", F.col("vb") - F.col("va"))


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, c, before``: each distinct value of a group, how often it occurs, and how many rows lie below it.

    Values are counted first, then dealt out by ranges of group and value and written; ranks are running sums within a
    range, plus the sums of the group's ranges before. So a group of any size is spread over tasks, and a value that many
    rows share is one row. Nulls and NaN are left out.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count("*").alias("c"))
    dealt = staged(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("c").alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the group
    sums = sums.select(*keys, "_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_b"))
    within = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_w", F.coalesce(F.sum("c").over(within), F.lit(0)))
    same = [own[k].eqNullSafe(sums[k]) for k in keys] + [own["_p"] == sums["_p"]]
    return own.join(sums, same).select(*(own[k] for k in keys), own[value], own["c"], (own["_w"] + sums["_b"]).alias("before"))


def quantiles(df: DataFrame, keys: list[str], value: str, **wanted: float) -> DataFrame:
    """Exact quantiles by linear interpolation, one column each name, and ``n``. Groups of any size; see ``value_ranks``."""
    v = value_ranks(df, keys, value)
    if keys:
        total = v.groupBy(*keys).agg(F.sum("c").alias("n"))
        v = v.alias("v").join(total.alias("t"), [F.col(f"v.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("v.*", "t.n")
    else:
        v = v.crossJoin(F.broadcast(v.agg(F.sum("c").alias("n"))))  # one row
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("c")), F.col(value).cast("double")))
    ends = [f(F.floor(place(q)) if low else F.ceil(place(q))).alias(f"_{name}{int(low)}") for name, q in wanted.items() for low, f in ((True, at), (False, at))]
    got = v.groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    part = lambda q: place(q) - F.floor(place(q))
    return got.select(*keys, "n", *((F.col(f"_{name}1") + (F.col(f"_{name}0") - F.col(f"_{name}1")) * part(q)).alias(name) for name, q in wanted.items()))


def signed_ranks(df: DataFrame, keys: list[str], delta: str = "delta", small: int = 50) -> DataFrame:
    """Per group: number, median of all deltas, rank sums of both signs without zeros, ties, normal statistic, effect
    size, share of positives. No task holds a group: ranks and medians come from ``value_ranks``.

    ``ranks2`` gives twice the ranks of all non-zero deltas, for groups of ``small`` at most. ``ties`` is a decimal: cubes of
    counts pass 64 bits from 2.1 million equal values on.
    """
    d = staged(df.where(F.col(delta).isNotNull() & ~F.isnan(delta)).select(*keys, F.col(delta).alias("_d")))
    med = quantiles(d, keys, "_d", median_delta=0.5).withColumnRenamed("n", "n_all")
    signs = d.where(F.col("_d") != 0).select(*keys, F.abs("_d").alias("_m"), F.col("_d"))
    ranks = staged(value_ranks(signs, keys, "_m")).withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)
    pos = signs.where("_d > 0").groupBy(*keys, "_m").agg(F.count("*").alias("pos"))
    t, whole = F.col("c"), F.col("c").cast("decimal(20,0)")
    r = ranks.join(pos, [*keys, "_m"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    some = [F.sort_array(F.flatten(F.collect_list(F.when(F.col("_n") <= small, F.array_repeat((2 * F.col("rank")).cast("int"), t.cast("int")))))).alias("ranks2")] if small else []
    if small:
        r = r.join(ranks.groupBy(*keys).agg(F.sum("c").alias("_n")), keys)
    agg = r.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(F.col("rank") * (t - F.col("pos"))).alias("w_minus"),
                               F.sum((whole * whole * whole - whole).cast("decimal(38,0)")).alias("ties"), F.sum("pos").alias("n_pos"), *some)
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties").cast("double") / 48
    return med.join(agg, keys, "left").withColumns({
        "z": F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)),
        "rank_biserial": F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")),
        "pct_positive": F.try_divide(F.col("n_pos").cast("double"), F.col("n"))})


def exact_p(ranks2: Column, w: Column) -> Column:
    """P(W+ >= w) when every sign is as likely as its opposite, ties or not. ``ranks2``: twice the ranks.

    The number of sign patterns for each sum of doubled ranks is built up rank by rank; counts below 2**53 are exact.
    """
    size = F.aggregate(ranks2, F.lit(0), lambda s, r: s + r)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size))
    places = F.sequence(F.lit(0), size)
    ways = F.aggregate(ranks2, start, lambda c, r: F.transform(places, lambda i: F.get(c, i) + F.coalesce(F.when(i >= r, F.get(c, i - r)), F.lit(0.0))))
    enough = F.slice(ways, F.ceil(2 * w).cast("int") + 1, size + 1)
    return F.aggregate(enough, F.lit(0.0), lambda s, v: s + v) / F.pow(F.lit(2.0), F.size(ranks2))


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal law, to 1e-12 or better: a series near 0, a continued fraction beyond."""
    x = F.abs(z)
    x2 = x * x
    density = F.exp(-x2 / 2) / math.sqrt(2 * math.pi)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")),
                       lambda a, i: F.struct((a["t"] * x2 / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * x2 / (2 * i + 1)).alias("s")))["s"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, i: x + i / a)
    tail = F.when(x < 3, 0.5 - density * near).otherwise(density / fraction)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def with_p(ranks: DataFrame, alternative: str | Column = "two-sided", exact_up_to: int = 50) -> DataFrame:
    """Adds ``p``: exact, with ties too, for groups that ``ranks2`` covers (see ``signed_ranks``) of up to 50 values, else normal.

    ``alternative`` (greater, less, two-sided) may be a column. Groups without a non-zero value have none.
    """
    side = F.lit(alternative) if isinstance(alternative, str) else alternative
    r2 = F.col("ranks2") if "ranks2" in ranks.columns else F.lit(None).cast("array<int>")
    exact = (F.size(r2) > 0) & (F.col("n") <= exact_up_to)
    # By symmetry P(W+ <= w) = P(W+ >= total - w), and the total is the sum of both rank sums.
    high = F.when(exact, exact_p(r2, F.col("w_plus"))).otherwise(upper_tail(F.col("z")))
    low = F.when(exact, exact_p(r2, F.col("w_minus"))).otherwise(upper_tail(-F.col("z")))
    p = F.when(side == "greater", high).when(side == "less", low).otherwise(F.least(F.lit(1.0), 2 * F.least(high, low)))
    # Written, so that the many later uses of a p-value do not work it out anew.
    return staged(ranks.withColumn("p", F.when(F.col("n") > 0, p)).drop("ranks2"))


def rejected(tests: DataFrame, family: list[str], how: str = "holm", alpha: float = 0.05) -> DataFrame:
    """Adds ``reject`` within each family: strict comparison; Holm stops at its first failure."""
    w = Window.partitionBy(*family)
    if how == "none":
        return tests.withColumn("reject", F.coalesce(F.col("p") < alpha, F.lit(False)))
    t = tests.withColumn("_m", F.count("p").over(w))
    if how == "bonferroni":
        return t.withColumn("reject", F.coalesce(F.col("p") < alpha / F.col("_m"), F.lit(False))).drop("_m")
    t = t.withColumn("_r", F.row_number().over(w.orderBy(F.col("p").asc_nulls_last())))
    t = t.withColumn("_bad", F.when(~F.coalesce(F.col("p") < alpha / (F.col("_m") - F.col("_r") + 1), F.lit(False)), F.col("_r")))
    return t.withColumn("reject", F.coalesce(F.col("_r") < F.min("_bad").over(w), F.lit(True)) & F.col("p").isNotNull()).drop("_m", "_r", "_bad")


def right_direction(delta: Column, expected: Column) -> Column:
    """A shift of 0 is never right."""
    return ((delta > 0) & (expected > 0)) | ((delta < 0) & (expected < 0))


def wrong_p(p: Column, one_sided: bool = True) -> Column:
    """The p-value against the expected direction: one-sided tests report it towards that direction."""
    return 1 - p if one_sided else p


def wrong_marker(delta: Column, p: Column, expected: Column, one_sided: bool = True) -> Column:
    """Marker of a shift in the wrong direction; empty for right ones, none expected, or missing values."""
    none = (expected == 0) | delta.isNull() | p.isNull() | right_direction(delta, expected)
    return F.when(none, "").otherwise(sig_marker(wrong_p(p, one_sided)))


def grade(steps: DataFrame, keys: list[str], alpha: float = 0.05, one_sided: bool = True) -> DataFrame:
    """Verdict per metric over its steps: columns expected (-1, 0, 1), shift and p.

    A step without data (a null shift) makes the metric "missing data"; an undefined p is not significant.
    """
    e = F.col("expected")
    right = F.coalesce(right_direction(F.col("shift"), e), F.lit(False))
    sig = F.coalesce(F.col("p") < alpha, F.lit(False))
    flip = ~right & F.coalesce(wrong_p(F.col("p"), one_sided) < alpha, F.lit(False))
    c = steps.groupBy(*keys).agg(F.count("*").alias("k"), F.count_if(F.col("shift").isNull()).alias("_miss"), F.max("expected").alias("_e"), F.count_if(flip).alias("_ws"),
                                 F.count_if(~right).alias("_w"), F.count_if(right & sig).alias("_rs"))
    of = lambda n: F.concat(F.col(n), F.lit("/"), F.col("k"))
    v = (F.when(F.col("_miss") > 0, "missing data").when(F.col("_e") == 0, "(no expectation)").when(F.col("_ws") > 0, F.concat(F.lit("WRONG DIRECTION ("), of("_ws"), F.lit(" sig.)")))
         .when(F.col("_w") > 0, F.concat(F.lit("NEAR-MONO (flip ns; "), of("_rs"), F.lit(" right-sig.)"))).when(F.col("_rs") == F.col("k"), "PASS (monotonic, all sig.)")
         .otherwise(F.concat(F.lit("monotonic, "), of("_rs"), F.lit(" sig."))))
    return c.select(*keys, v.alias("verdict"))


def bleed_through(cells: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Share of the original gap left after rewriting, four ways. ``cells``: keys, step, d_orig, d_simp of pairs."""
    medians_of = lambda by: quantiles(cells, by, "d_orig", mo=0.5).drop("n").join(quantiles(cells, by, "d_simp", ms=0.5).drop("n"), by)
    m = medians_of([*keys, step])
    pct = lambda a, b: 100 * F.try_divide(a, b)
    # A group has one row a step here.
    per = m.groupBy(*keys).agg(pct(F.avg("ms"), F.avg("mo")).alias("ratio_of_means"), F.median(pct(F.col("ms"), F.col("mo"))).alias("median_of_ratios"), pct(F.max_by("ms", step), F.max_by("mo", step)).alias("last_step"))
    return per.join(medians_of(keys).select(*keys, pct(F.col("ms"), F.col("mo")).alias("pooled")), keys)


def mean_sd(values: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    return values.where(f"{column} is not null and not isnan({column}) and {column} <> -1").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


def medians(values: DataFrame, keys: list[str], scale: float = 1.0, column: str = "value") -> DataFrame:
    return quantiles(values, keys, column, median=0.5).select(*keys, (F.col("median") * scale).alias("median"))


def box_summary(values: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Quartiles by linear interpolation; whiskers at the last values within 1.5 times their distance."""
    q = quantiles(values, keys, column, q1=0.25, med=0.5, q3=0.75).drop("n")
    iqr = 1.5 * (F.col("q3") - F.col("q1"))
    j = values.join(F.broadcast(q) if not keys else q, keys)
    return j.groupBy(*keys, "q1", "med", "q3").agg(F.min(F.when(F.col(column) >= F.col("q1") - iqr, F.col(column))).alias("lo"), F.max(F.when(F.col(column) <= F.col("q3") + iqr, F.col(column))).alias("hi"))
