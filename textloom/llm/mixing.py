"""Mixing sources to target weights, by DataFrame functions alone.

Targets: each source gets its weight's share of all words, capped at ``passes`` times its own size; what is above
is shared again by weight (water-filling, in closed form over the sources sorted by cap per weight). Schedule: slot
k of the mix is the golden-ratio point frac(k * phi), mapped through the cumulative shares to a source; slots are
ranked within their source. Each source is a shuffled stream of its documents, repeated ``passes`` times and cut
into blocks of equal words; the slot of rank r takes block r. A source whose target is under ``FEWEST`` blocks has
smaller blocks, and as many more slots, so that small sources come near their targets at any total.

Ranks and running sums of a source are made in two levels (chunks, then within a chunk), so a source with a third
of all rows is spread over many tasks. Null texts and texts without words have size 0 and are never taken; null
sources come last; a row without doc_id has its own place in the shuffle. Repeated rows are rows of their own, taken like
others, in an order that depends on their contents alone. Very long texts span many blocks. An empty table gives no
rows. Columns beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
PASSES = 3
FEWEST = 64
PHI = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size, shuffle``: a number of the row, number of words and the place in the shuffle.

    Row numbers tell repeated rows apart and hold once the table is stored.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
                       F.coalesce(F.expr(rf"cast(regexp_count(text, r'{WORD}') as long)"), F.lit(0)).alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).cast("binary")).alias("shuffle"))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``source, pos, weight, source_size, target``: one row a source; its windows run over that small table."""
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    pos = by.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("pos") % len(weights) + 1).cast("long")
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "pos")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = pos.withColumn("weight", weight).withColumn("_cap", passes * F.col("source_size"))
    df = df.withColumns({"_rest": F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
                         "_w": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # Below its cap: the level of those left, which is the same for each of them once the first one is below.
    df = df.withColumn("_full", F.col("_cap") * F.col("_w") <= F.col("weight") * F.col("_rest"))
    level = F.first(F.when(~F.col("_full"), F.struct("_rest", "_w")), ignorenulls=True).over(whole)
    df = df.withColumn("_level", level)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
        (F.col("weight") * F.col("_level._rest")).cast("double") / F.col("_level._w"))
    return df.select("source", "pos", "weight", "source_size", target.alias("target"))


def block_size(total: int, sources: int) -> int:
    """Words in a block: a source's share spans about a thousand blocks, within 16 to 1024 words."""
    return max(16, min(1024, total // max(1, sources * 1024)))


def blocks(target: DataFrame, words: int) -> DataFrame:
    """Adds ``words``, the words in a source's blocks, and ``due``, the number of blocks that its target makes."""
    own = F.greatest(F.lit(1), F.least(F.lit(words), F.floor(F.col("target") / FEWEST))).cast("long")
    return target.withColumn("words", own).withColumn("due", F.col("target") / F.col("words"))


def schedule(spark, target: DataFrame) -> DataFrame:
    """``slot, pos, rank``: the slots of the mix in order, each with its source and its rank in the source.

    ``target``: as ``blocks`` gives it. Points map through the cumulative numbers of blocks due.
    """
    slots = int(target.agg(F.coalesce(F.sum(F.ceil("due")), F.lit(0))).first()[0])
    point = F.col("slot") * F.lit(PHI)
    at = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x")) if slots else \
        spark.range(0).select(F.col("id").alias("slot"), F.lit(0.0).alias("x"))
    run = Window.orderBy("pos")
    share = target.withColumn("_to", F.sum("due").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.max("_to").over(Window.partitionBy(F.lit(1)))
    share = share.withColumns({"_whole": whole, "_last": F.max(F.when(F.col("target") > 0, F.col("pos"))).over(Window.partitionBy(F.lit(1)))}).where("target > 0")
    lo = F.coalesce(F.lag("_to").over(run), F.lit(0.0)) / F.col("_whole")
    hi = F.when(F.col("pos") == F.col("_last"), 2.0).otherwise(F.col("_to") / F.col("_whole"))
    # A source holds the cells of a grid that its stretch of the unit interval touches; a point meets those of its cell.
    cells = 4096
    grid = share.select("pos", lo.alias("lo"), hi.alias("hi")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))))
    hit = at.withColumn("cell", F.floor(F.col("x") * cells)).join(grid, "cell").where("x >= lo and x < hi").select("slot", "pos")
    # Rank within the source in two levels.
    per = 8192
    hit = hit.withColumn("part", F.floor(F.col("slot") / per))
    counts = hit.groupBy("pos", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("pos").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("pos", "part").orderBy("slot")) - 1
    return hit.withColumn("own", own).join(before, ["pos", "part"]).select("slot", "pos", (F.col("base") + F.col("own")).alias("rank"))


def streams(docs: DataFrame, rows: int) -> DataFrame:
    """Adds ``start``: words before the document in its source's shuffled stream, by chunks of the shuffle."""
    digits = 1
    while 16 ** digits * 4096 < rows and digits < 8:
        digits += 1
    df = docs.withColumn("part", F.substring("shuffle", 1, digits))
    sums = df.groupBy("source", "part").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = Window.partitionBy("source", "part").orderBy("shuffle", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return df.join(base, df["source"].eqNullSafe(base["source"]) & (df["part"] == base["part"])).select(
        df["row"], df["doc_id"], df["source"], df["size"], (F.col("base") + F.col("own")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, words: int | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: what the scheduled blocks take of each document."""
    spark = docs.sparkSession
    base = stored(sized(docs))
    target = stored(targets(base, weights, passes))
    total, n = target.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    target = stored(blocks(target, words or block_size(total, n)))
    slots = schedule(spark, target)
    doc = streams(base, base.count())
    t = target.select(F.col("source").alias("_source"), "pos", "source_size", "target", "words")
    doc = doc.join(t, doc["source"].eqNullSafe(t["_source"])).drop("_source")
    # Where the document lies in the repeated stream, and the blocks it touches there.
    lies = F.expr(f"explode_outer(if(size > 0, transform(sequence(0, {passes - 1}), p -> p * source_size + start), null))")
    spread = doc.select("*", lies.alias("at")).select("*", F.explode_outer(F.expr(
        "if(at is null, null, sequence(cast(floor(at / words) as long), cast(floor((at + size - 1) / words) as long)))")).alias("rank"))
    part = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * F.col("words")) - F.greatest("at", F.col("rank") * F.col("words"))
    got = slots.select("pos", "rank", F.lit(True).alias("yes"))
    return (spread.join(got, ["pos", "rank"], "left")
            .groupBy("row", "doc_id", "source", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(F.when(F.col("yes"), part)), F.lit(0)).alias("taken"))
            .select("doc_id", "source", "size", "source_size", "target", "taken"))
