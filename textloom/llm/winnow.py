"""Benchmark decontamination by winnowing, by DataFrame functions alone.

Windows are runs of ``n`` consecutive benchmark words; a benchmark item of fewer words, but not none, is one window.
Of each run of ``n`` document words the smallest hash of its ``k``-word grams is kept. A window that occurs in a
document has the same smallest hash there, so every occurrence is found: training fingerprints are joined with those
of the windows, and where they meet, the words themselves are compared. Windows shorter than ``n`` are fingerprinted
whole, once for each length that occurs.

Nothing is broadcast but tables of marked slots (``common.slots``), whose size is bounded whatever the benchmark's:
they keep fingerprints, windows and documents that cannot meet out of the shuffles, and the joins behind them are exact.

Null texts and texts without words have no windows and are never hit; nor is anything where the benchmark is empty. An
empty table gives no rows. Repeated rows get equal results, rows with a null doc_id are judged like others, a null
item_id counts for hits but is not listed. Texts of any length are read whole: the words and windows of one text are
the largest group. Columns beyond doc_id and text are ignored, and ``clean`` returns them as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import keyed, may_hold, packed, parted, slots, stored

# Fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N, K = 10, 5


def words(text: str = "text") -> Column:
    """Words after lower-casing A to Z alone; for ASCII texts ``lower`` does the same and is faster."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(k: int) -> str:
    return f"if(size(w) >= {k}, transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))})), cast(array() as array<long>))"


def _least(n: int, k: int) -> str:
    """The fingerprint of every window of n words, by window start."""
    many = ", ".join(f"g[i + {j}]" for j in range(n - k + 1))
    one = f"least({many})" if n > k else many
    return f"if(size(w) >= {n}, transform(sequence(0, size(w) - {n}), i -> {one}), cast(array() as array<long>))"


def _whole(m: int) -> str:
    return f"if(size(w) >= {m}, transform(sequence(0, size(w) - {m}), i -> xxhash64({m}, array_join(slice(w, i + 1, {m}), ' '))), cast(array() as array<long>))"


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """``item_id, m, win``: the windows of the benchmark, distinct within an item; m is the number of words."""
    df = items.select("item_id", words().alias("w")).where(F.size("w") > 0).withColumn("m", F.least(F.lit(n), F.size("w")))
    return df.select("item_id", "m", F.explode(F.expr("array_distinct(transform(sequence(0, size(w) - m), i -> array_join(slice(w, i + 1, m), ' ')))")).alias("win"))


def _met(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows whose ``fp`` is among the fingerprints of the benchmark."""
    return may_hold(rows, "fp", slots(prints, "fp")).where("_may").drop("_may").join(prints, "fp", "left_semi")


def hits(docs: DataFrame, items: DataFrame, n: int = N, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base table (``doc, th, doc_id, n_words``); ``doc, th, at, m, win``: where windows start in documents; the windows."""
    win = stored(windows(items, n))
    texts = win.select("m", "win").distinct()
    lengths = sorted(r["m"] for r in texts.select("m").distinct().collect())  # at most n
    prints = stored(texts.select(F.split("win", " ").alias("w"), "m").withColumn("g", F.expr(_grams(k))).select(F.explode(F.expr(
        f"if(m = {n}, {_least(n, k)}, array(xxhash64(m, array_join(w, ' '))))")).alias("fp")).distinct())
    marks = {"_g": F.expr(_grams(k))} if n in lengths else {}
    lists = {m: _least(n, k).replace("g[", "_g[") if m == n else _whole(m) for m in lengths}
    every = f"array_distinct(concat({', '.join(lists.values())}))" if lists else "cast(array() as array<long>)"
    base = stored(keyed(docs, "doc_id").withColumn("w", words()).withColumns({"n_words": F.size("w").cast("long"), **marks})
                  .select("doc", "th", "doc_id", "n_words", F.expr(every).alias("fps")))
    found = stored(_met(base.select("doc", "th", F.explode("fps").alias("fp")), prints).select("doc", "th").distinct())
    # Second reading: only documents that met a fingerprint, and of those only the places where they did.
    own = stored(parted(keyed(docs), found)[0].join(found, ["doc", "th"], "left_semi").withColumn("w", words()).select("doc", "th", "w").distinct())
    places = [own.withColumns(marks).select("doc", "th", F.lit(m).alias("m"), F.posexplode(F.expr(fp)).alias("at", "fp")) for m, fp in lists.items()]
    if not places:
        places = [own.select("doc", "th", F.lit(n).alias("m"), F.posexplode(F.expr("cast(array() as array<long>)")).alias("at", "fp"))]
    where = _met(functools.reduce(DataFrame.unionAll, places), prints).groupBy("doc", "th").agg(F.collect_set(F.struct("at", "m")).alias("met"))
    spots = own.join(where, ["doc", "th"]).select("doc", "th", F.explode(F.expr(
        "transform(met, x -> named_struct('at', x.at, 'm', x.m, 'win', array_join(slice(w, x.at + 1, x.m), ' ')))")).alias("s")).select("doc", "th", "s.*")
    return base, stored(spots.join(texts, ["m", "win"], "left_semi").select("doc", "th", "at", "m", "win")), win


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, k: int = K) -> DataFrame:
    """The query's columns, one row per row of ``docs``. Spots of one document are the largest group."""
    base, spots, win = hits(docs, items, n, k)
    order = Window.partitionBy("doc", "th").orderBy("at", "m").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("m")
    new = end - F.least(end, F.greatest(F.col("at"), F.coalesce(F.max(end).over(order), F.lit(0))))
    hit = spots.select("doc", "th", new.alias("new")).groupBy("doc", "th").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = win.groupBy("m", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    ids = (spots.select("doc", "th", "m", "win").distinct().join(owners, ["m", "win"]).select("doc", "th", F.explode("ids").alias("id"))
           .groupBy("doc", "th").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    out = base.drop("fps").join(hit, ["doc", "th"], "left").join(ids, ["doc", "th"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, n: int = N, k: int = K) -> DataFrame:
    """``docs``, all columns as they are, without the documents in which a window of the benchmark occurs.

    Repeated rows stay or go together. Only texts that may be among those found are shuffled.
    """
    _, spots, _ = hits(docs, items, n, k)
    found = stored(spots.select("doc", "th").distinct())
    some, rest = parted(packed(docs), found)
    return some.join(found, ["doc", "th"], "left_anti").select("row.*").unionAll(rest.select("row.*"))
