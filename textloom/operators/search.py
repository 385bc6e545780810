"""Phrase search with BM25, vector search, and search-based linking of records to dictionaries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from textloom.operators.index import idf, place, score, words
from textloom.operators.staging import staged
from textloom.session import ship



def lookup_hits(table: DataFrame, queries: DataFrame, k: int = 5, column: str = "title", columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """``query_id, rowid, rank, rn``: phrases sought in one short column, without an index.

    ``table``: rowid and the columns; ``queries``: query_id, phrases (array). Equal queries are searched once, and phrases
    of the same words count once a query. A phrase is compared only at places of its first two words, so neither
    common words nor other runs of words make rows.
    """
    dl = sum((F.coalesce(F.greatest(F.size(words(c)), F.lit(0)), F.lit(0)) for c in columns), F.lit(0))
    # Written, so that long columns are cut into words once.
    rows = staged(table.select("rowid", words(column).alias("w"), dl.alias("dl"))).where("dl > 0")
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    q = queries.select("query_id", F.array_distinct(F.filter(F.transform("phrases", words), lambda p: F.size(p) > 0)).alias("set"))
    sets = q.select("set").distinct().select("set", F.explode("set").alias("phrase"))
    start = lambda c: F.xxhash64(F.get(c, F.lit(0)), F.get(c, F.lit(1)))
    phrases = sets.select("phrase").distinct().withColumn("two", F.size("phrase") > 1).withColumn("h", F.when(F.col("two"), start(F.col("phrase"))).otherwise(F.xxhash64(F.col("phrase")[0])))
    at = rows.select("rowid", "dl", "w", F.posexplode("w").alias("i", "first"))
    both = F.array(F.struct(F.lit(False).alias("two"), F.xxhash64("first").alias("h")), F.struct(F.lit(True).alias("two"), F.xxhash64("first", F.get("w", F.col("i") + 1)).alias("h")))
    at = at.select("rowid", "dl", "i", "w", F.explode(both).alias("x")).select("rowid", "dl", "i", "w", "x.*")
    same = F.slice("w", F.col("i") + 1, F.size("phrase")) == F.col("phrase")
    hit = at.join(phrases, ["two", "h"]).where(same).groupBy("phrase", "rowid", "dl").agg(F.count("*").alias("tf"))
    df = hit.groupBy("phrase").agg(F.count("*").alias("n"))
    one = hit.join(df, "phrase").join(F.broadcast(stats)).select("phrase", "rowid", score(idf(F.col("n_docs"), F.col("n")), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("score"))  # one row
    out = sets.join(one, "phrase").groupBy("set", "rowid").agg((-F.sum("score")).alias("rank"))
    out = out.withColumn("rn", F.row_number().over(Window.partitionBy("set").orderBy(place("rank"), "rowid"))).where(F.col("rn") <= k)
    return q.join(out, "set").select("query_id", "rowid", "rank", "rn")


def admitted(table: DataFrame, wanted: tuple, columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """``rowid`` of the rows that a nested expression admits, as ``PositionalIndex.matching`` gives them, without an index:
    for one expression every text is cut into words once, where it lies, and nothing is written or shuffled.

    ``table``: rowid and the columns. Rows without words are left out.
    """
    # Words hold neither spaces nor signs, so a phrase is a run of words between spaces.
    line = lambda c: F.concat(F.lit(" "), F.array_join(F.coalesce(words(c), F.array().cast("array<string>")), " "), F.lit(" "))
    own = {c: f"_w{i}" for i, c in enumerate(columns)}

    def test(x: tuple) -> Column:
        if x[0] == "phrase":
            if x[1] is not None and x[1] not in columns:
                raise ValueError(f"no column {x[1]}")
            phrase = line(F.lit(x[2]))
            found = [F.contains(F.col(own[c]), phrase) for c in columns if x[1] in (None, c)]
            return (F.length(phrase) > 2) & reduce(or_, found)
        if x[0] in ("and", "or", "not") and len(x) > 1 and (x[0] != "not" or len(x) == 2):
            parts = [test(y) for y in x[1:]]
            return ~parts[0] if x[0] == "not" else reduce(and_ if x[0] == "and" else or_, parts)
        raise ValueError(f"no expression: {x!r}")

    # One struct of all lines, made by an explode, which no filter is merged into: so the words are made once a row.
    lines = table.select("rowid", F.explode(F.array(F.struct(*(line(c).alias(n) for c, n in own.items())))).alias("_x")).select("rowid", "_x.*")
    some = reduce(or_, (F.length(n) > 2 for n in own.values()))
    return lines.where(some & test(wanted)).select("rowid")


def metadata_filter(meta: Column, **want) -> Column:
    """Conjunction of equality tests on a JSON column: lists mean any of, strings and numbers equality."""
    test = F.lit(True)
    for k, v in want.items():
        got = F.get_json_object(meta, f"$.{k}")
        if isinstance(v, (list, tuple)):
            test = test & got.isin(*map(str, v))
        elif isinstance(v, str):
            test = test & got.eqNullSafe(F.lit(v))
        elif isinstance(v, (int, float)):
            test = test & (got.cast("double") == float(v))
        else:
            raise ValueError(f"cannot filter {k} by {type(v).__name__}")
    return test


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    if metric == "l2":
        return F.sqrt(total(F.transform(pairs, lambda v: v * v)))
    if metric == "l1":
        return total(F.transform(pairs, lambda v: F.abs(v)))
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
        norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x.cast("double"))))
        return 1 - F.try_divide(dot, norm(a) * norm(b))
    raise ValueError(metric)


PIVOTS, CHUNK, PAIRS = 256, 4096, 1 << 17


def pivots(vectors: DataFrame, most: int = PIVOTS) -> DataFrame:
    """One row, ``pivots``: vectors that stand for cells, as many as the square root of the rows and ``most`` at most.

    ``vectors``: rowid, v. They are chosen by a hash of the number, so reruns agree.
    """
    n = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("rowid"), "rowid").limit(max(1, min(most, int(n ** 0.5))))
    return chosen.agg(F.collect_list("v").alias("pivots"))


def _matrices(column: pa.Array):
    """Rows of an array column as matrices, one for each width: (places, matrix)."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.r_[0, np.cumsum(n)]
    for width in np.unique(n):
        at = np.flatnonzero(n == width)
        yield at, flat[start[at][:, None] + np.arange(width)]


def _lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for c in x.T:
        total += c * c
    return np.sqrt(total)


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of rows of ``a`` to rows of ``b``; components are added in their order, as ``distance`` adds them, so
    both give the same bits."""
    total, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        if metric == "cosine":
            np.multiply(x[:, None], y, out=part)
        else:
            np.subtract(x[:, None], y, out=part)
            np.multiply(part, part, out=part) if metric == "l2" else np.abs(part, out=part)
        total += part
    if metric == "cosine":
        return 1 - total / (_lengths(a)[:, None] * _lengths(b))
    return np.sqrt(total) if metric == "l2" else total


def _to_pivots(x: np.ndarray, pivots: list, metric: str) -> np.ndarray:
    """Distances to every pivot, of unit vectors under cosine. A pivot of another width, or no number, is at distance 0, which
    prunes nothing."""
    out = np.zeros((len(x), len(pivots)))
    at = [i for i, p in enumerate(pivots) if len(p) == x.shape[1]]
    if at:
        p = np.array([pivots[i] for i in at], np.float64).reshape(len(at), -1)
        unit = (lambda v: v / _lengths(v)[:, None]) if metric == "cosine" else (lambda v: v)
        out[:, at] = pair_distances(unit(x), unit(p), "l1" if metric == "l1" else "l2")
    return np.nan_to_num(out, nan=0.0, posinf=np.inf)


def _placed(df: DataFrame, column: str, pivots: list, metric: str, whole: bool) -> DataFrame:
    """Adds ``ds``, the distances to all pivots (``whole``), or ``cell`` and ``r``, the nearest one from 1 and its distance."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # ``most`` vectors at most

    def fn(batches):
        for b in batches:
            ds = np.zeros((b.num_rows, len(shared.value)))
            for at, x in _matrices(b.column(column)):
                for i in range(0, len(at), 512):
                    ds[at[i:i + 512]] = _to_pivots(x[i:i + 512], shared.value, metric)
            if whole:
                new = {"ds": pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * ds.shape[1], pa.int32()), pa.array(ds.ravel()))}
            else:
                new = {"cell": pa.array(ds.argmin(1) + 1, pa.int32()), "r": pa.array(ds.min(1))}
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], names=[*b.schema.names, *new])

    schema = StructType(list(df.schema.fields))
    schema = schema.add("ds", ArrayType(DoubleType())) if whole else schema.add("cell", "integer").add("r", "double")
    return df.mapInArrow(fn, schema)


def _best_in_chunk(k: int, metric: str):
    """Of one chunk's rows, the k nearest to each query that asks for the chunk, ties by rowid."""
    def fn(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"_q": [], "rowid": [], "distance": []}
        if asked.num_rows and rows.num_rows:
            asked, rows = asked.combine_chunks(), rows.combine_chunks()
            dq, cap, limit = (asked.column(c).to_numpy() for c in ("dq", "cap", "limit"))
            number, r, ids = asked.column("_q").to_numpy(), rows.column("r").to_numpy(), rows.column("rowid").to_numpy()
            own = {x.shape[1]: (at, x) for at, x in _matrices(rows.column("embedding").chunk(0))}
            for at, q in _matrices(asked.column("q").chunk(0)):
                if q.shape[1] not in own:
                    continue
                mine, x = own[q.shape[1]]
                order = np.argsort(r[mine], kind="stable")
                mine, x = mine[order], x[order]
                order = np.argsort(dq[at], kind="stable")
                at, q = at[order], q[order]
                step = max(1, PAIRS // len(x))
                for i in range(0, len(at), step):
                    j = at[i:i + step]
                    lo, hi = np.searchsorted(r[mine], (dq[j] - limit[j]).min()), np.searchsorted(r[mine], (dq[j] + limit[j]).max(), "right")
                    if lo >= hi:
                        continue
                    d = pair_distances(q[i:i + step], x[lo:hi], metric)
                    keep = ~(d > cap[j][:, None])
                    if d.shape[1] > k:
                        keep &= ~(d > np.partition(d, k - 1, axis=1)[:, k - 1:k])
                    a, b = np.nonzero(keep)
                    d, rowid = d[a, b], ids[mine[lo + b]]
                    order = np.lexsort((rowid, d, a))
                    a, d, rowid = a[order], d[order], rowid[order]
                    first = np.arange(len(a)) - np.searchsorted(a, a) < k
                    for name, values in zip(found, (number[j][a], rowid, d)):
                        found[name].append(values[first])
        kinds = (pa.int64(), rows.schema.field("rowid").type, pa.float64())
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for (n, v), t in zip(found.items(), kinds)})
    return fn


def nearest(queries: DataFrame, table: DataFrame, k: int = 4, metric: str = "l2", on: list[str] | None = None, most: int = PIVOTS, seen: dict | None = None) -> DataFrame:
    """``query_id, rowid, distance, rn``: the k nearest rows of each query, ties by rowid; exact.

    ``queries``: query_id, q, and the columns ``on``; ``table``: rowid, embedding, and the same columns. Rows belong to the
    cell of their nearest pivot, and a row's distance to it is stored. A query first meets the nearest cells that hold k
    rows; the k-th distance found there leaves out every cell, and within cells every row, that the triangle inequality
    puts beyond it. Cells are dealt out in chunks, so no task holds a whole one; a chunk meets its queries as matrices and
    gives k rows a query at most. Cosine distances are pruned as Euclidean ones of unit vectors; rows without a distance
    (null vectors or components, zero vectors under cosine, other widths) are nobody's neighbours.
    ``seen`` gets the numbers of pairs that may be scored and of all pairs, for which extra jobs run.
    """
    keys = list(on or [])
    if metric not in ("l2", "l1", "cosine"):
        raise ValueError(metric)
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    some = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()) & (F.lit(metric != "cosine") | F.exists(c, lambda x: x != 0))
    rows = staged(table.where(some("embedding")).select("rowid", *keys, double("embedding").alias("embedding")))
    asked = staged(queries.where(some("q")).select("query_id", *keys, double("q").alias("q"), F.monotonically_increasing_id().alias("_q")))
    chosen = pivots(rows.withColumnRenamed("embedding", "v"), most).first()["pivots"]
    base = staged(_placed(rows, "embedding", chosen, metric, False))
    cells = base.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    cells = staged(cells.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    base = base.join(F.broadcast(cells.select(*keys, "cell", "chunks")) if not keys else cells.select(*keys, "cell", "chunks"), [*keys, "cell"])
    base = base.withColumn("chunk", F.pmod(F.xxhash64("rowid"), F.col("chunks")).cast("int")).drop("chunks")
    # Each query with all cells of its group in one array, nearest first, each with the least distance a row in it can have.
    group = cells.groupBy(*keys).agg(F.collect_list(F.struct("cell", "n", "low", "high", "chunks")).alias("cells"))
    q = _placed(asked.drop("query_id"), "q", chosen, metric, True).withColumn("nearest", F.array_min("ds"))
    q = q.join(group, keys) if keys else q.crossJoin(F.broadcast(group))  # one row without keys
    dq = lambda c: F.element_at("ds", c["cell"])
    bound = lambda c: F.greatest(dq(c) - c["high"], c["low"] - dq(c), (dq(c) - F.col("nearest")) / 2, F.lit(0.0))
    q = q.withColumn("cells", F.array_sort(F.transform("cells", lambda c: F.struct(dq(c).alias("dq"), c["cell"].alias("cell"), c["n"].alias("n"), c["chunks"].alias("chunks"), bound(c).alias("least")))))
    before = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("i")), lambda s, c: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + c["n"]).alias("n"), (s["i"] + 1).alias("i"))))
    q = staged(q.withColumn("first", before["i"]).drop("ds", "nearest"))
    parts = [*keys, "cell", "chunk"]

    def met(cells: DataFrame) -> DataFrame:
        """Queries with the chunks of ``c``, one cell each."""
        return cells.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("c.chunks") - 1)), "cell": F.col("c.cell"), "dq": F.col("c.dq")}).drop("c")

    def scored(cells: DataFrame) -> DataFrame:
        """The k nearest rows of every chunk that may lie within ``limit`` of a query."""
        wide = F.lit(float("inf"))
        one = met(cells).select("_q", "q", "dq", F.coalesce("limit", wide).alias("limit"), F.coalesce("cap", wide).alias("cap"), *parts)
        kind = StructType().add("_q", "long").add("rowid", base.schema["rowid"].dataType).add("distance", "double")
        return one.groupBy(*parts).cogroup(base.select("rowid", "embedding", "r", *parts).groupBy(*parts)).applyInArrow(_best_in_chunk(k, metric), kind)

    top = lambda df: df.withColumn("rn", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "rowid"))).where(F.col("rn") <= k)
    none = F.lit(None).cast("double")
    begun = q.select("_q", *keys, "q", none.alias("limit"), none.alias("cap"), F.explode(F.slice("cells", 1, F.col("first"))).alias("c"))
    found = staged(top(scored(begun)))
    limit = F.sqrt(2 * F.greatest("distance", F.lit(0.0))) + 1e-6 if metric == "cosine" else F.col("distance") * (1 + 1e-9) + 1e-12
    kth = found.where(F.col("rn") == k).select("_q", limit.alias("limit"), F.col("distance").alias("cap"))
    rest = q.join(kth, "_q", "left").select("_q", *keys, "q", "limit", "cap", F.explode(F.slice("cells", F.col("first") + 1, F.size("cells"))).alias("c"))
    rest = rest.where("limit is null or c.least <= limit")
    if seen is not None:
        within = lambda cells: met(cells).join(base, parts).where(F.col("limit").isNull() | (F.abs(F.col("dq") - F.col("r")) <= F.col("limit"))).count()
        seen.update(scored=within(begun) + within(rest), pairs=asked.count() * rows.count())
    return top(found.drop("rn").unionByName(scored(rest))).join(asked.select("_q", "query_id"), "_q").select("query_id", "rowid", "distance", "rn")


def lookup_titles(hits: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per query: for each key that the first hit has, the distinct values of all hits."""
    j = hits.join(rows, "rowid")
    first = {k: F.max(F.when(F.col("rn") == 1, F.col(k).isNotNull().cast("int"))) for k in keys}
    return j.groupBy("query_id").agg(*(F.when(first[k] == 1, F.array_sort(F.collect_set(F.when(F.col(k) != "", F.col(k))))).alias(k) for k in keys))


def reverse_checked(neighbours: DataFrame, lookups: DataFrame) -> DataFrame:
    """Per query, the nearest neighbour that a title lookup of the neighbour leads back to, with its distance.

    ``neighbours``: query_id, rowid, distance, rn; ``lookups``: rowid, query_id (ids that the reverse lookup found).
    """
    ok = neighbours.join(lookups.select("rowid", "query_id").distinct(), ["rowid", "query_id"], "left_semi")
    return ok.groupBy("query_id").agg(F.min_by(F.struct("rowid", "distance"), "rn").alias("b")).select("query_id", "b.rowid", "b.distance")


def min_distance(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy("query_id", key).agg(F.min("distance").alias("distance"))
