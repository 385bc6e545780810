"""Integer vectors: exact components, checks, and blocks of vectors packed into one row each.

A component x becomes ``floor(scale * x)`` in double arithmetic, held as a long (beyond the long range, its nearest end).
Only vectors without null, NaN or infinite components take part. A row of a packed table holds a few thousand vectors in
vertical layout: all first components, then all second ones, and so on, in the narrowest integer type that holds them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import prepared, stored

LONG = np.iinfo(np.int64)
#: Sums of products below this are exact in double arithmetic, with room for bounds.
EXACT = float(1 << 52)


def usable(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``vec_id, v`` (array of doubles, not empty or of ``size`` components): rows whose vectors are whole and finite.

    Equal rows, of the same id and vector, count once.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(fine & ((F.size("v") == size) if size else (F.size("v") > 0))).distinct()


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(v * float(scale))
    big, small = x >= 2.0 ** 63, x < -(2.0 ** 63)
    out = np.where(big | small, 0, x).astype(np.int64)
    out[big], out[small] = LONG.max, LONG.min
    return out


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """The bytes of an array and its width."""
    for t in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max):
            return np.ascontiguousarray(x, t).tobytes(), t().itemsize
    return np.ascontiguousarray(x, np.int64).tobytes(), 8


def wide(data: bytes, width: int, dim: int) -> np.ndarray:
    """``dim`` rows of components."""
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(dim, -1)


def top(x: np.ndarray) -> int:
    """Largest magnitude, as a Python integer."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


PACKED = "g long, dim int, n int, ids binary, width int, data binary, top double"


def packed(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """A stored table of blocks of about ``size`` vectors: rows ``vec_id, v`` dealt out by a hash of both.

    ``g`` numbers the blocks from 0 without gaps for each dimension; ids are longs, null as the largest one.
    """
    prepared(rows.sparkSession)
    rows = stored(rows)
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    many = F.lit(1)
    for d, n in counts.items():
        many = F.when(F.size("v") == d, max(1, math.ceil(n / size))).otherwise(many)
    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), many).alias("g"))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, col = key[1].as_py(), table.column("v").combine_chunks()
        x = integers(np.asarray(col.flatten()).reshape(-1, dim), scale).T
        ids = table.column("vec_id").fill_null(LONG.max).to_numpy()
        order = np.argsort(ids, kind="stable")
        data, width = narrow(x[:, order])
        return pa.table({"g": [key[0].as_py()], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary()), "top": [float(top(x))]})

    return stored(dealt.groupBy("g", "dim").applyInArrow(pack, PACKED))
