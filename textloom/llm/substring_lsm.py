"""Substring dedup of words with a log-structured fingerprint index.

A window is ``n`` consecutive words. Every window has one fingerprint: its smallest ``k``-word gram, leftmost on
ties, so equal windows have equal fingerprints and neighbouring windows share one. Batches of documents, ascending
by doc_id, become sorted immutable runs (fingerprint, first and last document) in bucketed tables under the index's
folder; each batch is merge-joined with the older runs without a shuffle of those; when ``fanout`` runs have gathered,
the two smallest neighbours are merged, and the old ones are deleted. An index can be closed and opened again
(``RunIndex.open``), so that ``dedup_batch`` finds what a new batch shares with history from runs alone.

The fingerprints that a batch shares with history, or that two of its documents share, are marked. Verification reads
the texts, takes the windows whose fingerprint is marked, and compares whole windows by hashes of 96 bits: a window counts as
repeated if the first document that holds it is smaller. A slot marked by chance only costs a comparison.

Copies of a whole text are found first by SHA-256 and left out of the index (every window of a later copy also
starts in the first one). Null texts have no words. A null doc_id ranks after all others; documents with equal
doc_id never remove from one another. Repeated rows get equal results. Very long texts are read whole by the task that
holds them; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.common import Marks, arrow, chunks, keyed, row_key, shared_dir, stored, text_buffer

N, K, CHUNK = 13, 5, 1 << 20
INSIDE = ~C.SPACE_BYTES


class Copies:
    """First documents of equal texts, as marks that also let some later copies pass, and the later copies.

    First documents are stored before they are joined, so that the rows of a large group of copies can be split.
    """

    def __init__(self, docs: DataFrame):
        rows = stored(docs.select("doc", "th", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")))
        first = stored(rows.groupBy("sha").agg(F.min("doc").alias("first")))
        rows = stored(rows.join(first, "sha").select("doc", "th", (F.col("doc") > F.col("first")).alias("copy")))
        self.later = rows.where("copy").select("doc", "th").distinct()
        self.firsts = row_marks(rows.where("not copy").select("doc", "th"))


def row_marks(rows: DataFrame) -> Marks:
    """Marks of rows, by the key that ``row_key`` gives."""
    keys = arrow(lambda b: [{"key": row_key(b["doc"].to_numpy(), b["th"].to_numpy()).view(np.int64)}], rows.select("doc", "th"), "key long")
    return Marks(stored(keys), "key")


def windows_of(data: np.ndarray, off: np.ndarray, n: int, k: int):
    """Words of some texts and the windows of each fingerprint: (starts, ends, rows, hashes), (first, count, place, g)."""
    s, e, row = C.word_spans(data, off, INSIDE)
    h = C.span_hashes(data, s, e)
    g = C.grams(h, k)
    first, count, place = C.minimisers(g, row, n, n - k + 1)
    return (s, e, row, h), (first, count, place, g)


def _index(batch: DataFrame, firsts: Marks, n: int, k: int) -> DataFrame:
    """``g, lo, hi``: fingerprints of the documents that are not later copies, once for each record batch, with their
    first and last document; so a very frequent one is a few rows."""
    def fn(b):
        mine = firsts.passes(row_key(b["doc"].to_numpy(), b["th"].to_numpy()))
        doc = b["doc"].to_numpy()[mine]
        data, off = text_buffer(b["text"].filter(pa.array(mine)))
        found = []
        for i, j in chunks(off, CHUNK):
            (_, _, row, _), (first, _, place, g) = windows_of(data[off[i]:off[j]], off[i:j + 1] - off[i], n, k)
            if len(first):
                found.append((g[place].view(np.int64), doc[i:j][row[first]]))
        if found:
            g, d = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(g)
            g, d = g[order], d[order]
            lead = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            yield {"g": g[lead], "lo": np.minimum.reduceat(d, lead), "hi": np.maximum.reduceat(d, lead)}

    return arrow(fn, batch, "g long, lo long, hi long")


class RunIndex:
    """Sorted immutable runs in bucketed tables under a folder, merged when ``fanout`` of them have gathered.

    Runs are external tables: their files stay in the folder, which all executors share, and only their names are in the
    session's catalog. ``close`` writes the list of runs; ``open`` reads it and names them anew.
    """

    def __init__(self, spark, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout, self.runs, self.made = spark, fanout, [], 0
        self.path = path or shared_dir(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def open(cls, spark, path: str, fanout: int = 4) -> "RunIndex":
        """The index at a path, empty if there is none."""
        index = cls(spark, path, fanout)
        if index._files().exists(index._at("list")):
            last = max(int(s.getPath().getName()) for s in index._files().listStatus(index._at("list")))
            state = json.loads(spark.read.text(f"{path}/list/{last}").first()[0])
            index.buckets, index.made = state["buckets"], last
            for name in state["runs"]:
                spark.sql(f"create table if not exists {name} (g long, lo long, hi long) using parquet clustered by (g) sorted by (g) into {index.buckets} buckets location '{path}/{name}'")
            index.runs = state["runs"]
        return index

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def close(self) -> None:
        self.made += 1
        state = json.dumps({"buckets": self.buckets, "runs": self.runs})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.path}/list/{self.made}")

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        table = f"run_{uuid.uuid4().hex}"
        with C.tidy(self.spark):
            df.write.option("path", f"{self.path}/{table}").bucketBy(self.buckets, "g").sortBy("g").format("parquet").saveAsTable(table)
        return table

    def _delete(self, table: str) -> None:
        self.spark.sql(f"drop table if exists {table}")
        self._files().delete(self._at(table), True)

    def add(self, prints: DataFrame) -> DataFrame:
        """Adds a batch's (g, lo, hi); returns the fingerprints that it shares with older runs or within itself."""
        run = prints.repartition(self.buckets, "g").groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        table = self._write(run)
        new, shared = self.spark.table(table), None
        parts = [new.where("lo < hi").select("g")]
        parts += [new.join(self.spark.table(old).hint("merge"), "g", "left_semi").select("g") for old in self.runs]
        for p in parts:
            shared = p if shared is None else shared.unionAll(p)
        self.runs.append(table)
        return shared

    def compact(self) -> None:
        """Merges the two oldest runs while there are ``fanout`` or more; a full outer merge join needs no shuffle."""
        while len(self.runs) >= self.fanout:
            a, b = self.runs[:2]
            x, y = self.spark.table(a), self.spark.table(b).hint("merge").withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
            both = x.join(y, "g", "full_outer").select("g", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
            self.runs = [self._write(both), *self.runs[2:]]
            for old in (a, b):
                self._delete(old)

    def drop(self) -> None:
        for t in self.runs:
            self._delete(t)
        self.runs = []


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """Up to ``n`` batches by ranges of doc, ascending."""
    cuts = sorted(set(docs.approxQuantile("doc", [i / n for i in range(1, n)], 0.01) or []))
    edges, out = [None, *map(int, cuts), None], []
    for a, b in zip(edges, edges[1:]):
        df = docs
        if a is not None:
            df = df.where(F.col("doc") >= a)
        if b is not None:
            df = df.where(F.col("doc") < b)
        out.append(df)
    return out


def repeats(docs: DataFrame, n: int = N, k: int = K, n_batches: int = 3, chunk: int = CHUNK):
    """``doc, th, at, n``: per row, the window starts that also start in a smaller document (n is 1); and the later copies.

    ``docs``: as ``keyed`` gives them. An index of this call's own takes them in batches.
    """
    copies = Copies(docs)
    # Two runs are merged before a third batch comes, so that it is joined with one run and not with each batch before it.
    index, shared = RunIndex(docs.sparkSession, fanout=2), None
    try:
        for batch in batches(docs, n_batches):
            index.compact()
            found = stored(index.add(_index(batch, copies.firsts, n, k)))
            shared = found if shared is None else shared.unionAll(found)
    finally:
        index.drop()
    return verified(docs, shared, copies, n, k, chunk), copies.later


def verified(docs: DataFrame, shared: DataFrame, copies: Copies, n: int, k: int, chunk: int = CHUNK) -> DataFrame:
    """Windows under the shared fingerprints that also start in a smaller document, gathered by row.

    Windows are compared by two hashes of their words over different byte values, of 64 and 32 bits.
    """
    marks, firsts = Marks(shared, "g"), copies.firsts

    def fn(b):
        data, off = text_buffer(b["text"])
        doc, th = b["doc"].to_numpy(), b["th"].to_numpy()
        mine = firsts.passes(row_key(doc, th))
        for i, j in chunks(off, chunk):
            raw = data[off[i]:off[j]]
            (s, e, row, h), (first, count, place, g) = windows_of(raw, off[i:j + 1] - off[i], n, k)
            if not len(first):
                continue
            ok = mine[i:j][row[first]] & marks.passes(g[place])
            first, count = first[ok], count[ok]
            if not len(first):
                continue
            at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            base = np.searchsorted(row, np.arange(j - i))  # first word of each row
            r = row[at]
            other = C.grams(C.span_hashes32(raw, s, e).view(np.uint32).astype(np.uint64), n)[at] >> np.uint64(32)
            yield {"wh": C.grams(h, n)[at].view(np.int64), "w2": other.astype(np.uint32).view(np.int32), "doc": doc[i:j][r], "th": th[i:j][r], "at": (at - base[r]).astype(np.int32)}

    wins = stored(arrow(fn, docs, "wh long, w2 int, doc long, th long, at int"))
    # First holders are stored before they are joined, so that the rows of a very frequent window can be split.
    first = stored(wins.groupBy("wh", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("wh", "w2", "lo"))
    per = gathered(wins.join(first, ["wh", "w2"]).where("lo < doc").select("doc", "th", "at", F.lit(1).alias("n")))
    marks.drop()
    firsts.drop()
    return per


def gathered(hits: DataFrame) -> DataFrame:
    """``doc, th, at, n``: the hits of each row, as a stored table of arrays."""
    return stored(hits.groupBy("doc", "th").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")))


def marked_rows(docs: DataFrame, per: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with hits or copies, joined with them (``at`` and ``n`` arrays, ``copy``), and the other rows.

    Only rows whose slot is marked are shuffled; a row marked by chance just finds nothing to join.
    """
    later = stored(later)
    marked = row_marks(per.select("doc", "th").unionAll(later))

    def part(side):
        def run(it):
            for b in it:
                keep = marked.passes(row_key(b["doc"].to_numpy(), b["th"].to_numpy())) == side
                if keep.any():
                    yield b.filter(pa.array(keep))
        return docs.mapInArrow(run, docs.schema)

    joined = part(True).join(per, ["doc", "th"], "left").join(later.withColumn("copy", F.lit(True)), ["doc", "th"], "left")
    return joined, part(False)


def _finish(n: int):
    def fn(b):
        data, off = text_buffer(b["text"])
        has = "at" in b.schema.names
        at = b["at"] if has else None
        copy = b["copy"].fill_null(False).to_numpy(zero_copy_only=False) if has else np.zeros(b.num_rows, bool)
        words, removed, sha = [], [], []
        for i in range(b.num_rows):
            raw = data[off[i]:off[i + 1]]
            s, e, _ = C.word_spans(raw, np.array([0, len(raw)]), INSIDE)
            gone = np.zeros(len(s) + 1, np.int32)
            if copy[i] and len(s) >= n:
                gone[0] += 1
            elif has and at[i].is_valid:
                a = at[i].values.to_numpy()
                np.add.at(gone, a, 1)
                np.add.at(gone, a + n, -1)
            keep = np.cumsum(gone)[:-1] == 0
            text = bytes(raw)
            words.append(len(s))
            removed.append(int(len(s) - keep.sum()))
            sha.append(hashlib.sha256(b" ".join([text[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())])).hexdigest())
        yield {"doc_id": b["doc_id"], "n_words": words, "n_removed": removed, "kept_sha256": sha}
    return fn


def dedup(docs: DataFrame, n: int = N, k: int = K, n_batches: int = 3) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    own = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    per, later = repeats(keyed(docs), n, k, n_batches)
    joined, rest = marked_rows(own, per, later)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return arrow(_finish(n), joined, schema).unionAll(arrow(_finish(n), rest, schema))


def dedup_batch(index: RunIndex, batch: DataFrame, history: DataFrame, n: int = N, k: int = K) -> DataFrame:
    """The query's columns for the rows of a batch, against itself and the documents before it; the index takes it in.

    What may be shared comes from the index's runs; ``history`` (the documents that it has taken) is read once more,
    only for the windows to compare. With batches ascending by doc_id, the results are those of all documents at once.
    """
    own, every = keyed(batch), keyed(history.select("doc_id", "text").unionAll(batch.select("doc_id", "text")))
    copies = Copies(every)
    shared = stored(index.add(_index(own, copies.firsts, n, k)))
    per = verified(every, shared, copies, n, k)
    joined, rest = marked_rows(keyed(batch, F.col("doc_id").cast("long").alias("doc_id")), per, copies.later)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return stored(arrow(_finish(n), joined, schema).unionAll(arrow(_finish(n), rest, schema)))
