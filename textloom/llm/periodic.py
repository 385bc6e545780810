"""Periodic runs of words by block matching.

A run is a stretch of consecutive words with smallest period q, at least ``max(12, 2 q)`` words long, that no neighbouring
word extends. Blocks of a power of two of words at aligned places are the keys of an Aho-Corasick automaton over integer
sequences, which is run across the document. An occurrence of a block at a distance that fits the block's scale is a seed,
and the seed is extended in both directions by comparing words. The blocks find every run: the words of a run that equal
the word q further on number ``m >= max(q, 12 - q)``, so

* with q <= 14, ``m >= 6``: they hold a block of 4 words that starts at an even place;
* with ``2 L - 1 <= q <= 4 L - 2`` and L = 8, 16, ...: ``m >= 2 L - 1``, so they hold an aligned block of L words.

A block can only recur where its halves do, so each scale keys just the blocks whose halves recur far enough away, and a
document in which no four words come twice is done after one sort. A stretch of period q whose smallest period is a divisor
of q lies in the run of that divisor, which is found before.

Documents are independent, so nothing is shuffled; a document is one unit of work. Null and empty texts have no words and
no runs. Rows that repeat, or have no ``doc_id``, each have a result of their own. An empty table gives an empty result,
and only ``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow, prepared

LEAST, BASE, BASE_MOST = 12, 4, 14


def numbers(words: list) -> np.ndarray:
    """Equal words get equal numbers."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def recurring(x: np.ndarray, size: int) -> np.ndarray:
    """By start: whether the ``size`` words hash like another such stretch. A filter: it may pass others too."""
    with np.errstate(over="ignore"):
        g = np.zeros(len(x) - size + 1, np.uint64)
        for k in range(size):
            g = (g ^ x[k:len(x) - size + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(g), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seeds(x: np.ndarray, text: tuple, starts: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the blocks at ``starts`` (sorted): starts and distances within ``least``..``most``, and for each block
    the distance of its last occurrence."""
    keys: dict[tuple, int] = {}
    key = np.fromiter((keys.setdefault(text[j:j + size], len(keys)) for j in starts.tolist()), np.int64, len(starts))
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, i in keys.items():
        found.add_word(k, i)
    found.make_automaton()
    hits = np.array(list(found.iter(text)), np.int64).reshape(-1, 2)
    at, of = hits[:, 0] - size + 1, hits[:, 1]
    last = np.zeros(len(keys), np.int64)
    np.maximum.at(last, of, at)
    # Blocks ordered by key and start; for each occurrence, those of its key that start at a fitting distance before it.
    n = len(x) + 1
    order = np.argsort(key, kind="stable")
    places = key[order] * n + starts[order]
    lo = np.searchsorted(places, of * n + np.maximum(at - most, 0))
    hi = np.searchsorted(places, of * n + np.maximum(at - least, -1), "right")
    many = np.maximum(hi - lo, 0)
    many[at < least] = 0
    row = np.repeat(np.arange(len(at)), many)
    pick = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    j = starts[order][pick]
    return j, at[row] - j, last[key] - starts


def extended(x: np.ndarray, a: int, b: int, q: int) -> tuple[int, int]:
    """The widest ``s <= a`` and ``e >= b`` with ``x[i] == x[i + q]`` for all i in [s, e)."""
    end, step = len(x) - q, 16
    while b < end:
        m = min(step, end - b)
        off = x[b:b + m] != x[b + q:b + q + m]
        if off.any():
            b += int(off.argmax())
            break
        b, step = b + m, step * 4
    step = 16
    while a > 0:
        m = min(step, a)
        off = x[a - m:a] != x[a - m + q:a + q]
        if off.any():
            a -= int(off[::-1].argmax())
            break
        a, step = a - m, step * 4
    return a, b


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start, then period."""
    n = len(x)
    if n < LEAST:
        return []
    starts = np.flatnonzero(recurring(x, BASE)[::2]) * 2
    if not len(starts):
        return []
    text = tuple(x.tolist())
    by_period: dict[int, list[tuple[int, int]]] = {}
    size, least, most = BASE, 1, BASE_MOST
    while len(starts) and 2 * least <= n:
        j, q, far = seeds(x, text, starts, size, least, most)
        order = np.lexsort((j, q))
        j, q = j[order], q[order]
        cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(q)]):
            p, k = int(q[a]), a
            shorter = [r for d, at in by_period.items() if d < p and p % d == 0 for r in at]
            while k < b:
                s = e = int(j[k])
                inside = next((v for u, v in shorter if u <= s and s + size + p <= v), None)
                if inside is not None:  # the stretch lies in a run of a divisor, as do all seeds up to its end
                    e = inside - p - size + 1
                else:
                    s, e = extended(x, s, s + size, p)
                    if e - s + p >= max(LEAST, 2 * p) and not any(u <= s and e + p <= v for u, v in shorter):
                        by_period.setdefault(p, []).append((s, e + p))
                k = a + int(np.searchsorted(j[a:b], e))  # further seeds in this stretch tell nothing new
        # The next scale's blocks are those both of whose halves recur at its least distance or beyond.
        least, most, half = (4 * size - 1, 8 * size - 2, size)
        size *= 2
        alive = np.zeros(n + size, bool)
        alive[starts[far >= least]] = True
        starts = np.arange(0, n - size + 1, size)
        starts = starts[alive[starts] & alive[starts + half]]
    return sorted((s, e - s, p) for p, at in by_period.items() for s, e in at)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        step[s + p] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


def planted(doc_id: int | None, words: list) -> list:
    """The query's text: one document in ten, by a hash of its number, is periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _found(col: pa.Array, ids: list, edit) -> tuple[list, list, list]:
    count, runs, texts = [], [], []
    for d, t in zip(ids, col):
        w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes part at the six ASCII blanks alone
        if edit:
            w = edit(d, w)
        r = runs_of(numbers(w))
        count.append(len(w))
        runs.append(r)
        texts.append(b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept(len(w), r)).tolist()]))
    return count, runs, texts


def find(docs: DataFrame, edit: Callable | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: every run by start, then period, and the words that stay, joined by one space.

    ``edit``, if given, is a function of doc_id and words that gives the words to look at.
    """
    def work(b):
        n, runs, texts = _found(b.column("text"), b.column("doc_id").to_pylist(), edit)
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32))
        yield {"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "runs": pa.ListArray.from_arrays(offsets, each),
               "collapsed": pa.array(texts, pa.binary()).cast(pa.string())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(work, rows, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def collapse(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each run cut to its first period; texts without runs stay as they are."""
    prepared(docs.sparkSession)

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            _, runs, texts = _found(b.column(i).cast(pa.string()), [None] * b.num_rows, None)
            new = [t.decode("utf-8", "surrogatepass") if r else o for t, r, o in zip(texts, runs, b.column(i).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:i], pa.array(new, b.schema.field(i).type), *b.columns[i + 1:]], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, edit: Callable | None = planted) -> DataFrame:
    """One row a document: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    r = find(docs, edit).withColumn("best", best)
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
                    F.floor(F.expr("1000 * best.l div -best.p")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
