"""Document fingerprints: canonical exact digests.

The canonical text is NFKC-normalised, case-folded (normalised once more, as folding may undo the form) and has its
runs of white space folded to one space and its ends stripped. Its 128-bit xxhash is the digest. Canonical texts whose
digest occurs more than once are compared byte by byte by grouping on digest and text; a second text under one digest,
should there ever be one, gets its rank among the texts of that digest as a suffix. So equal fingerprints mean equal
canonical texts, and the likeness of two fingerprints is 1 or 0.

Null texts are empty. Rows with a null doc_id follow all others; rows that tie on doc_id are ordered by text. With one
row, the next document is the row itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import LAST_ID, arrow, key_bitmap, passes, prepared, stored

BITS = 24


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def likeness(a: str, b: str) -> float:
    return float(a == b)


def _range_of(col, cuts: list[int], a: int = 0, b: int | None = None):
    """Index of the last cut at or below ``col``: a balanced tree of comparisons."""
    b = len(cuts) if b is None else b
    if b - a == 1:
        return F.lit(a)
    m = (a + b) // 2
    return F.when(col < cuts[m], _range_of(col, cuts, a, m)).otherwise(_range_of(col, cuts, m, b))


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``part, sent, doc, doc_id, text``: documents dealt out by ranges of doc, sorted within each.

    The first document of each range also goes, as a sentinel, to the end of the range before it (of the last, for the
    first range), so that every document finds its successor in its own task. A range holds whole runs of equal doc.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = own.agg(F.min("doc")).first()[0]
    if low is None:
        low = 0
    real = own.where(F.col("doc") < LAST_ID)
    # The cuts are rows' own ids, one for each range at most, so each range begins with one.
    cuts = sorted({low, *map(int, real.approxQuantile("doc", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [])})
    rows = own.withColumn("part", _range_of(F.col("doc"), cuts))
    lead = Window.partitionBy("part").orderBy("text")
    first = rows.where(F.col("doc").isin(cuts)).withColumn("rn", F.row_number().over(lead)).where("rn = 1")
    first = first.withColumn("part", F.pmod(F.col("part") - 1, F.lit(len(cuts))).cast("int"))
    cols = ("doc", "doc_id", "text")
    every = rows.select("part", F.lit(False).alias("sent"), *cols).unionAll(first.select("part", F.lit(True).alias("sent"), *cols))
    return every.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("part", "sent", "doc", "text")


def edited(docs: DataFrame, suffix: dict[bytes, str] | None = None, width: int = 32) -> DataFrame:
    """Each document with its own and its edited fingerprint and likenesses. One shuffle of the texts.

    ``suffix``: what follows the digest of canonical texts that are not the first under it.
    """
    more = suffix or {}

    def run(it):
        held = None
        for b in it:
            out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for part, sent, doc_id, text in zip(*(b[c].to_pylist() for c in ("part", "sent", "doc_id", "text"))):
                canon = canonical(text)
                if held is not None and held[0] == part:
                    _, i, t, c = held
                    k = len(t) // 4
                    new = t[:len(t) - k] + text[:k]
                    e = canonical(new)
                    row = (i, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), digest(c)[:width] + more.get(c, ""),
                           digest(e)[:width] + more.get(e, ""), float(c == e), float(c == canon))
                    for key, v in zip(out, row):
                        out[key].append(v)
                held = None if sent else (part, doc_id, text, canon)
            if out["doc_id"]:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    prepared(docs.sparkSession)
    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def collisions(docs: DataFrame, prints: DataFrame, width: int = 32) -> dict[bytes, str]:
    """Suffixes of canonical texts beyond the first under one digest, found by comparing bytes; empty in practice.

    Only texts whose digest repeats are compared; a fixed-size bitmap of repeated digests keeps the others out of the
    shuffle. Equal texts merge before it, so a large group of copies is a few rows.
    """
    slot = F.expr("shiftleft(cast(conv(substr(fingerprint, 1, 15), 16, 10) as long), 4)").alias("key")
    twice = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(slot)
    marks = docs.sparkSession.sparkContext.broadcast(key_bitmap(twice, "key", BITS))

    def fn(b):
        canon = [canonical(t) for t in b["text"].to_pylist()]
        own = [digest(c)[:width] for c in canon]
        key = np.array([(int(x[:15], 16) << 4) % (1 << 64) for x in own], np.uint64)
        keep = np.flatnonzero(passes(marks.value, key, BITS))
        yield {"own": [own[i] for i in keep], "canon": [canon[i] for i in keep]}

    texts = arrow(fn, docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "own string, canon binary").distinct()
    many = texts.groupBy("own").agg(F.count("*").alias("n"), F.min("canon").alias("first")).where("n > 1").drop("n")
    clash = texts.join(many, "own").withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy("canon"))).where("rank > 1")
    return {bytes(r["canon"]): f":{r['rank']}" for r in clash.select("canon", "rank").toLocalIterator()}


def report(docs: DataFrame, width: int = 32) -> DataFrame:
    """The query's columns, one row per row of ``docs``. ``width``: hex digits of the digest kept (32: all of it)."""
    rows = stored(edited(docs, None, width))
    clash = collisions(docs, rows, width)
    return edited(docs, clash, width) if clash else rows
