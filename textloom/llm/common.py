"""Shared pieces: the shared folder, Arrow text buffers, rolling hashes, minimisers and key bitmaps.

Rows with a null ``doc_id`` rank after every other document; rows that repeat a ``doc_id`` are
told apart by a hash of their text, so equal rows get equal results.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.session import ship

LAST_ID, ROWS, BATCH_BYTES = (1 << 63) - 1, 1500, 16 << 20
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only where that is unset, and only in a local session, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, _OWN[app][7:], ignore_errors=True)
        base = _OWN[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the queries run inside are dropped as soon as each has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc`` (doc_id, nulls last), ``th`` (hash of the text), ``text`` and the columns named."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"), *more)


def lowest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest ``key``, a hash; ties by the other columns. As a stored table.

    Only the rows of a share of the hash's range that should hold 8 times as many are sorted, so no task gathers more
    than that however many rows there are; where repeats leave fewer than ``n`` in that share, all rows are sorted.
    """
    total = rows.count()
    some = rows
    if total > 8 * n:
        top = int(8 * n / total * float(1 << 64)) - (1 << 63)
        some = rows.where(F.col(key) < F.lit(top))
    out = stored(some.orderBy(key, *(c for c in rows.columns if c != key)).limit(n))
    return out if some is rows or out.count() >= n else stored(rows.orderBy(key, *(c for c in rows.columns if c != key)).limit(n))


# ---- Arrow text buffers -------------------------------------------------------------------------

def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and ``n + 1`` offsets into them; null texts are empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---- rolling hashes -----------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_OTHER = np.random.default_rng(20240608).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in (("p", _P), ("i", _PINV)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, in place."""
    for m in (_M1, _M2):
        x ^= x >> np.uint64(33)
        x *= m
    x ^= x >> np.uint64(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * P**i`` modulo 2**64, of length n + 1."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0], out=out[1:])
    return out


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values, by start."""
    return grams_of(prefix(values), k)


def grams_of(h: np.ndarray, k: int) -> np.ndarray:
    """The same from prefix sums."""
    n = len(h) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = h[k:] - h[:n]
    x *= _powers(n)[1]
    return mix(x)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of bytes with ``inside``; runs never cross rows."""
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= w[cut]
    last[cut - 1] |= w[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    return spans_of(prefix(byte_values(data)), s, e) if len(s) else np.zeros(0, np.uint64)


def spans_of(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The same from prefix sums of ``byte_values``."""
    x = (h[e] - h[s]) * _powers(len(h))[1][s]
    return mix(x + (e - s).astype(np.uint64))


def span_hashes32(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A second hash of each byte span, of 32 bits, over other byte values."""
    if not len(s):
        return np.zeros(0, np.int32)
    n = len(data)
    p, i = _powers(n + 1)
    h = np.zeros(n + 1, np.uint32)
    np.cumsum(_OTHER[data] * p[:n].astype(np.uint32), out=h[1:])
    x = ((h[e] - h[s]) * i[s].astype(np.uint32)).astype(np.uint64)
    return (mix(x + (e - s).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by start: block-wise prefix and suffix minima."""
    n = len(v)
    if n < w:
        return v[:0]
    m = -(-n // w) * w
    x = np.full(m, np.iinfo(v.dtype).max, v.dtype)
    x[:n] = v
    x = x.reshape(-1, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n - w + 1], pre[w - 1:n])


def minimisers(g: np.ndarray, row: np.ndarray, width: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``width`` values inside one row: the place of its smallest gram, leftmost on ties.

    ``g``: gram hashes by start, ``row``: row number of each value, ``w``: grams in a window. Returns runs of
    consecutive windows with one minimiser: first window starts, numbers of windows, gram places. The choice
    depends on the window's content alone, so equal windows choose equal grams.
    """
    n = len(row) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    v = (g >> np.uint64(24) << np.uint64(24)) if len(g) < 1 << 24 else None
    if v is None:  # a very long row: by parts that overlap
        parts, step = [], (1 << 24) - 2 * width
        for a in range(0, n, step):
            b = min(n, a + step)
            s, c, p = minimisers(g[a:b + w - 1], row[a:b + width - 1], width, w)
            parts.append((s + a, c, p + a))
        return tuple(np.concatenate(x) for x in zip(*parts))
    v |= np.arange(len(g), dtype=np.uint64)
    m = sliding_min(v, w)[:n]
    at = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
    ok = np.flatnonzero(row[:n] == row[width - 1:width - 1 + n])
    if not len(ok):
        z = np.zeros(0, np.int64)
        return z, z, z
    a = at[ok]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)])
    return ok[new], np.diff(np.r_[new, len(ok)]), a[new]


# ---- key bitmaps --------------------------------------------------------------------------------

def key_bitmap(keys: DataFrame, col: str, bits: int) -> np.ndarray:
    """Bit per slot, the ``bits`` below the 16 top ones of a 64-bit key. As keys grow it only passes more.

    The top bits are left out because keys chosen as the least of many, like anchors, have few values there.
    """
    words = keys.select(F.shiftrightunsigned(F.shiftleft(F.col(col), 16), 64 - bits).alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bit"))
    with tidy(keys.sparkSession):
        got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["word"].to_numpy()] = got["bit"].to_numpy()
    return out.view(np.uint64)


def bits_for(keys: int, least: int = 20, most: int = 28) -> int:
    """Bits of a bitmap with about 16 slots a key, within 128 KB and 32 MB."""
    return max(least, min(most, (16 * max(1, keys) - 1).bit_length()))


def passes(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = keys.view(np.uint64) << np.uint64(16) >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Marks:
    """A bitmap of a stored table's keys (64-bit hashes), sized by their number, that workers share."""

    def __init__(self, keys: DataFrame, col: str, most: int = 28):
        self.bits = bits_for(keys.count(), most=most)
        self.shared = keys.sparkSession.sparkContext.broadcast(key_bitmap(keys, col, self.bits))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """True for all keys of the table, and for about one in 16 others (more of them beyond ``2**(most - 4)`` keys)."""
        return passes(self.shared.value, keys, self.bits)

    def drop(self) -> None:
        self.shared.destroy()


def slots(keys: DataFrame, col: str, most: int = 24) -> tuple[DataFrame, int]:
    """The same as a table ``_word, _bits`` for plans of SQL functions alone, and its number of slots' bits.

    At most ``2**(most - 6)`` rows of two longs, whatever the number of keys, so it may always be broadcast.
    """
    bits = bits_for(keys.count(), 12, most)
    slot = F.shiftrightunsigned(F.xxhash64(F.col(col)), 64 - bits)
    words = keys.select(slot.alias("_s")).select(F.shiftright("_s", 6).alias("_word"), F.expr("shiftleft(1L, cast(_s & 63 as int))").alias("_bit"))
    return stored(words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))), bits


def may_hold(df: DataFrame, col: str, found: tuple[DataFrame, int], name: str = "_may") -> DataFrame:
    """Adds whether the slot of ``col`` is marked: true for all keys of ``slots``, and for few others by chance."""
    words, bits = found
    slot = F.shiftrightunsigned(F.xxhash64(F.col(col)), 64 - bits)
    out = df.withColumn("_slot", slot).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"), "left")
    return out.withColumn(name, F.expr("coalesce(shiftright(_bits, cast(_slot & 63 as int)) & 1L, 0L) = 1L")).drop("_slot", "_word", "_bits")


def packed(docs: DataFrame) -> DataFrame:
    """``doc, th`` as ``keyed`` gives them and ``row``, a struct of all columns, whatever their names."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("th"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def parted(rows: DataFrame, found: DataFrame, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows whose (doc, th) may be among those of ``found``, a stored table, and rows whose are not.

    The first ones are few unless most rows are found: so a join with ``found`` shuffles little else.
    """
    key = F.xxhash64("doc", "th").alias("_k")
    marked = may_hold(rows.withColumn("_k", key), "_k", slots(found.select(key), "_k", most)).drop("_k")
    return marked.where("_may").drop("_may"), marked.where("not _may").drop("_may")


def row_key(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Key of a row from its document and text hash, as ``row_key_col`` gives it."""
    return mix(doc.view(np.uint64) * _P + th.view(np.uint64))


def prepared(spark: SparkSession) -> None:
    """Workers get the package, and record batches of at most ``ROWS`` rows and about ``BATCH_BYTES`` bytes.

    A single longer text still makes a batch of its own. Smaller limits that the session has already are kept.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, str(most))


def arrow(fn, df: DataFrame, schema: str) -> DataFrame:
    """``mapInArrow`` by a function from one record batch to any number of column dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepared(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)
    target = to_arrow_schema(spark_schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                for out in fn(b):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, spark_schema)
