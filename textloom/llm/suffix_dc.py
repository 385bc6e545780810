"""Suffix-array dedup of bytes: distributed difference-cover suffix sorting.

Every string of ``n`` bytes has one anchor, its smallest ``k``-byte gram (leftmost on ties), so equal strings have
equal anchors. Anchors that occur in two documents or more are marked; only strings whose anchor is marked can repeat.
Neighbouring strings with one anchor form a snippet. Snippets are told apart by 96 bits of hash, and one
representative of each, with its bytes, is dealt out by anchor. Each task sorts all suffixes of its snippets by the
difference cover modulo 3: sampled triples are sorted and named, the names are sorted by recursion, the remaining
suffixes are merged in, and neighbours in the order are compared by their first ``n`` bytes. Recursion stops once the
names cover ``n`` bytes. Strings that compare equal get the smallest document that holds one of them, and every place
of a snippet learns from its representative which of its strings start in a smaller document.

An anchor of ``hot`` documents or more could gather too many snippets in one task; its strings are snippets of their own
there, dealt out by their contents. A slot marked by chance only costs work: results do not depend on it.

Copies of a whole text are found first by SHA-256 and left out (all strings of a later copy also start in the first
one). Null texts are empty. A null doc_id ranks after all others; documents with equal doc_id never remove from one
another. Repeated rows get equal results; texts of fewer than ``n`` bytes are kept whole, very long ones are read in one
piece by the task that holds them. An empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.common import Marks, arrow, chunks, keyed, prepared, row_key, stored, text_buffer
from textloom.llm.substring_lsm import Copies, gathered, marked_rows, row_marks

N, K, CHUNK, HOT = 50, 26, 1 << 19, 50_000
PIECE = 1 << 18


# ---- the suffix sort ------------------------------------------------------------------------------

def _names(*cols: np.ndarray) -> tuple[np.ndarray, int]:
    """Names 1, 2, ... of the tuples, in their order."""
    key, top, room = cols[0].astype(np.uint64), int(cols[0].max(initial=0)) + 1, max(1, (len(cols[0]) - 1).bit_length())
    for c in cols[1:]:
        m = int(c.max(initial=0)) + 1
        if (top * m - 1).bit_length() + room > 64:  # too wide to be sorted as one word: name what there is so far
            key, top = _dense(key, top)
            key, top = key.astype(np.uint64), top + 1
        key, top = key * np.uint64(m) + c.astype(np.uint64), top * m
    if top <= 4 * len(key):  # small alphabet: a table of what occurs
        seen = np.zeros(top + 1, np.int64)
        seen[key.astype(np.int64)] = 1
        table = np.cumsum(seen)
        return table[key.astype(np.int64)], int(table[-1])
    return _dense(key, top)


def _dense(key: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    order, new = _sorted(key, top)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def _sorted(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys below ``top``, and where a new one begins. Key and place are sorted as one word where they fit."""
    room = max(1, (len(key) - 1).bit_length())
    if (top - 1).bit_length() + room > 64:
        order = np.argsort(key, kind="stable")
        k = key[order]
    else:
        k = key.astype(np.uint64) << np.uint64(room) | np.arange(len(key), dtype=np.uint64)
        k.sort()
        order = (k & np.uint64((1 << room) - 1)).astype(np.int64)
        k >>= np.uint64(room)
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    return order, new


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of ``s`` (symbols from 1 up) by at least ``depth`` symbols, equal ones sharing a rank.

    Difference cover modulo 3: positions 1 and 2 modulo 3 are sampled.
    """
    n = len(s)
    if depth <= 1 or n < 3:
        if n < 3:  # too short to sample
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            out = np.empty(n, np.int64)
            out[order] = np.arange(1, n + 1)
            return out
        return s.astype(np.int64)
    z = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    p1, p2, p0 = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    p = np.concatenate([p1, p2])
    name, count = _names(z[p], z[p + 1], z[p + 2])
    if count < len(p):  # ties: sort the string of names, those of positions 1 first; a 0 parts the two
        # Names are raised by one so that the separator is smaller than any of them.
        r = np.concatenate([name[:len(p1)] + 1, [1], name[len(p1):] + 1])
        rr = suffix_ranks(r, -(-depth // 3))
        name, count = _names(np.concatenate([rr[:len(p1)], rr[len(p1) + 1:]]))
    rank = np.zeros(n + 4, np.int64)
    rank[p] = name
    # Remaining suffixes: first symbol, then the sampled rank that follows. Merge by the cover's comparisons:
    # against position 1, (symbol, rank); against position 2, (symbol, symbol, rank).
    two = lambda q: (z[q], rank[q + 1])
    three = lambda q: (z[q], z[q + 1], rank[q + 2])
    a, na = _names(*(np.concatenate(x) for x in zip(two(p0), two(p1))))
    b, nb = _names(*(np.concatenate(x) for x in zip(three(p0), three(p2))))
    a0, a1, b0, b2 = a[:len(p0)], a[len(p0):], b[:len(p0)], b[len(p0):]
    # A suffix's place is the number of suffixes before it, whichever kind they are. Names are dense, so these are
    # running sums of how often each name occurs.
    below = lambda x, top: np.cumsum(np.bincount(x, minlength=top + 1)) - np.bincount(x, minlength=top + 1)
    every, f0, f1, g0, g2 = below(name, count), below(a0, na), below(a1, na), below(b0, nb), below(b2, nb)
    out = np.empty(n, np.int64)
    out[p0] = f0[a0] + f1[a0] + g2[b0]
    out[p1] = every[rank[p1]] + f0[a1]
    out[p2] = every[rank[p2]] + g0[b2]
    return out + 1


def equal_classes(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Class number of the ``n`` bytes at each start: sort suffixes, then compare neighbours by their first n bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(data, n)[starts]
    order, new = _sorted(ranks.astype(np.uint64), int(ranks.max()) + 1)
    at = starts[order]
    # Equal ranks agree on n symbols already; of the others, neighbours are compared 8 bytes at a time.
    todo = np.flatnonzero(new[1:]) + 1
    x, y = at[todo], at[todo - 1]
    raw = np.append((data - 2).astype(np.uint8), np.zeros(8, np.uint8))
    if n >= 8:
        wide = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
        steps = [*range(0, n - 8, 8), n - 8]
    else:
        wide, steps = raw, range(n)
    for i in steps:
        eq = wide[x + i] == wide[y + i]
        todo, x, y = todo[eq], x[eq], y[eq]
    new[todo] = False
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def smallest(snips: pa.Array, lo: np.ndarray, n: int) -> list[np.ndarray]:
    """For each snippet, by start in it: the smallest document of all strings equal to the one there."""
    data, off = text_buffer(snips)
    size = np.diff(off)
    # Snippets are parted by a symbol of their own, below all bytes.
    sym = np.ones(len(data) + len(size), np.int64)
    shift = np.repeat(np.arange(len(size)), size)
    sym[np.arange(len(data)) + shift] = data.astype(np.int64) + 2
    count = size - n + 1
    begin = off[:-1] + np.arange(len(size))
    starts = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    cls = equal_classes(sym, starts, n)
    best = np.full(int(cls.max()) + 1, C.LAST_ID, np.int64)
    np.minimum.at(best, cls, np.repeat(lo, count))
    return best[cls], count


# ---- the distributed part -------------------------------------------------------------------------

def _anchors(data, off, n, k):
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    h = C.prefix(C.byte_values(data))
    g = C.grams_of(h, k)
    return (row, *C.minimisers(g, row, n, n - k + 1), g, h)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def repeated_anchors(docs: DataFrame, firsts: Marks, n: int, k: int, chunk: int = CHUNK) -> DataFrame:
    """``g, n``: anchors in two documents or more, and in how many (255 of a record batch at most), as a stored table.

    Anchors travel as sorted arrays, one row for each record batch and bucket: bits of the anchor below the 16 top ones,
    in which the smallest of many grams have few values. They are rotated, so that a bucket is a range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (8 * parts - 1).bit_length())

    def keys(b):
        mine = firsts.passes(row_key(b["doc"].to_numpy(), b["th"].to_numpy()))
        data, off = text_buffer(b["text"].filter(pa.array(mine)))
        found = []
        for i, j in chunks(off, chunk):
            row, _, _, place, g, _ = _anchors(data[off[i]:off[j]], off[i:j + 1] - off[i], n, k)
            if len(place):
                x = g[place]
                found.append((x << np.uint64(16) | x >> np.uint64(48), row[place] + i))
        if not found:
            return
        g, r = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(g)
        g, r = g[order], r[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        several = np.minimum.reduceat(r, first) < np.maximum.reduceat(r, first)
        times = np.diff(np.r_[first, len(g)])
        g, count = g[first], np.where(several, np.minimum(times, 255), 1).astype(np.uint8)
        bucket = (g >> np.uint64(64 - bits)).astype(np.int64)
        lead = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[lead[1:], len(g)]
        yield {"bucket": bucket[lead], "g": _binary(g.view(np.uint8), 8 * ends), "n": _binary(count, ends)}

    dealt = arrow(keys, docs, "bucket long, g binary, n binary").repartition(parts, "bucket").sortWithinPartitions("bucket")

    def merged(held: list):
        g = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in held])
        c = np.concatenate([np.frombuffer(x, np.uint8) for _, x in held])
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        lead = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        return g[lead], np.add.reduceat(c.astype(np.int64), lead)

    def count(it):
        held, now = [], None
        def out():
            g, c = merged(held)
            g = g >> np.uint64(16) | g << np.uint64(48)
            return pa.RecordBatch.from_arrays([pa.array(g[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["g", "n"])
        for b in it:
            for key, g, c in zip(b["bucket"].to_pylist(), b["g"].to_pylist(), b["n"].to_pylist()):
                if key != now and held:
                    yield out()
                    held = []
                now = key
                held.append((g, c))
        if held:
            yield out()

    prepared(docs.sparkSession)
    return stored(dealt.mapInArrow(count, "g long, n long"))


def repeats(docs: DataFrame, n: int = N, k: int = K, hot: int = HOT, chunk: int = CHUNK):
    """``doc, th, at, n``: per row, runs of starts of strings that also start in a smaller document; and the later copies."""
    copies = Copies(docs)
    firsts = copies.firsts
    seen = repeated_anchors(docs, firsts, n, k, chunk)
    marks, heat = Marks(seen, "g"), Marks(seen.where(F.col("n") >= hot), "g")

    def snippets(b):
        """Snippets under marked anchors, chunk by chunk: bytes, rows, places in the rows, starts, counts, anchors, hashes."""
        mine = firsts.passes(row_key(b["doc"].to_numpy(), b["th"].to_numpy()))
        own_rows = np.flatnonzero(mine)
        data, off = text_buffer(b["text"].filter(pa.array(mine)))
        for i, j in chunks(off, chunk):
            part, po = data[off[i]:off[j]], off[i:j + 1] - off[i]
            row, first, count, gram, g, h = _anchors(part, po, n, k)
            if not len(first):
                continue
            key = g[gram]
            ok = marks.passes(key)
            first, count, key = first[ok], count[ok], key[ok]
            warm = heat.passes(key)
            if warm.any():  # one string a snippet, keyed by its content
                c = count[warm]
                f = np.repeat(first[warm] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
                own = C.grams_of(h, n)[f]
                first, count, key = np.r_[first[~warm], f], np.r_[count[~warm], np.ones(len(f), np.int64)], np.r_[key[~warm], own]
            if len(first):
                ends, r = first + count + n - 1, row[first]
                yield part, own_rows[i + r], first - po[r], first, count, key, C.spans_of(h, first, ends).view(np.int64), C.span_hashes32(part, first, ends)

    def kinds_of(b):
        doc, got = b["doc"].to_numpy(), []
        for _, r, _, _, _, key, sk, s2 in snippets(b):
            got.append((sk, s2, doc[r], key.view(np.int64)))
        if got:
            sk, s2, d, g = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(sk)
            sk, s2, d, g = sk[order], s2[order], d[order], g[order]
            lead = np.flatnonzero(np.r_[True, (sk[1:] != sk[:-1]) | (s2[1:] != s2[:-1])])
            yield {"g": g[lead], "sk": sk[lead], "s2": s2[lead], "lo": np.minimum.reduceat(d, lead), "hi": np.maximum.reduceat(d, lead)}

    span = (F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kinds = stored(arrow(kinds_of, docs, "g long, sk long, s2 int, lo long, hi long").groupBy("g", "sk", "s2").agg(*span))
    # Anchors that were marked by chance, of one document alone, go before any bytes travel.
    shared = stored(kinds.groupBy("g").agg(*span).where("lo < hi").select("g"))
    kinds = stored(kinds.join(shared, "g", "left_semi"))
    # Each kind's representative lies in its smallest document.
    chosen, many = row_marks(kinds.select(F.col("lo").alias("doc"), F.col("sk").alias("th"))), Marks(kinds.where("lo < hi"), "sk")

    def representatives(b):
        doc = b["doc"].to_numpy()
        for part, r, _, first, count, key, sk, s2 in snippets(b):
            ok = np.flatnonzero(chosen.passes(row_key(doc[r], sk)))
            if not len(ok):
                continue
            order = ok[np.lexsort((doc[r[ok]], s2[ok], sk[ok]))]
            x, y = sk[order], s2[order]
            order = order[np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]]
            size = count[order] + n - 1
            ends = np.cumsum(size)
            take = np.repeat(first[order] - np.r_[0, ends[:-1]], size) + np.arange(ends[-1])
            yield {"g": key[order].view(np.int64), "sk": sk[order], "s2": s2[order], "lo": doc[r[order]], "snip": _binary(part[take], ends)}

    def sort_piece(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        sk, s2, lo, snip = (t[c].chunk(0) for c in ("sk", "s2", "lo", "snip"))
        best, count = smallest(snip, lo.to_numpy(), n)
        off = np.r_[0, np.cumsum(count)]
        low, top = np.minimum.reduceat(best, off[:-1]), np.maximum.reduceat(best, off[:-1])
        # Snippets of one document alone, whose strings no smaller document holds, remove nothing.
        keep = np.flatnonzero((low < lo.to_numpy()) | many.passes(sk.to_numpy()))
        even = low[keep] == top[keep]
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(best)).take(pa.array(keep))
        lists = pc.if_else(pa.array(even), pa.scalar(None, lists.type), lists)
        return pa.RecordBatch.from_arrays([sk.take(pa.array(keep)), s2.take(pa.array(keep)), pa.array(low[keep], mask=~even), lists], names=["sk", "s2", "lo", "low"])

    def sort_task(it):
        """Rows come sorted by g; a piece ends between two values of g."""
        held, size = [], 0
        for b in it:
            if not b.num_rows:
                continue
            g = b["g"].to_numpy()
            held.append(b)
            size += b["snip"].nbytes
            if size < PIECE:
                continue
            edge = np.flatnonzero(g[1:] != g[:-1]) + 1
            # Cut at about every PIECE bytes; the last value of g may go on in the next batch.
            sizes = np.cumsum(np.diff(text_buffer(b["snip"])[1]))
            begin, base = 0, 0
            held.pop()
            for e in edge.tolist():
                if sizes[e - 1] - base >= PIECE or e == edge[-1]:
                    yield sort_piece([*held, b.slice(begin, e - begin)])
                    held, begin, base = [], e, int(sizes[e - 1])
            held.append(b.slice(begin))
            size = sum(x["snip"].nbytes for x in held)
        if held:
            yield sort_piece(held)

    prepared(docs.sparkSession)
    dealt = arrow(representatives, docs, "g long, sk long, s2 int, lo long, snip binary").repartition("g").groupBy("g", "sk", "s2", "snip").agg(F.min("lo").alias("lo"))
    dealt = dealt.sortWithinPartitions("g").select("g", "sk", "s2", "lo", "snip")
    known = stored(dealt.mapInArrow(sort_task, "sk long, s2 int, lo long, low array<long>"))
    wanted = Marks(known, "sk")

    def places(b):
        doc, th = b["doc"].to_numpy(), b["th"].to_numpy()
        for _, r, at, _, count, _, sk, s2 in snippets(b):
            ok = wanted.passes(sk)
            if ok.any():
                r = r[ok]
                yield {"sk": sk[ok], "s2": s2[ok], "doc": doc[r], "th": th[r], "at": at[ok].astype(np.int32), "n": count[ok].astype(np.int32)}

    def runs(b):
        """Runs of strings that start in a smaller document, of each place."""
        doc, th, at, count = (b[c].to_numpy() for c in ("doc", "th", "at", "n"))
        plain = np.flatnonzero(b["low"].is_null().to_numpy(zero_copy_only=False))
        out = [(doc[plain], th[plain], at[plain], count[plain])]
        rest = np.setdiff1d(np.arange(b.num_rows), plain)
        if len(rest):
            low = b["low"].take(pa.array(rest)).flatten().to_numpy()
            c = count[rest]
            own = np.repeat(np.arange(len(rest)), c)
            less = low < doc[rest][own]
            head = np.flatnonzero(less & np.r_[True, ~less[:-1] | (own[1:] != own[:-1])])
            tail = np.flatnonzero(less & np.r_[~less[1:] | (own[1:] != own[:-1]), True])
            base = np.cumsum(c) - c
            who = rest[own[head]]
            out.append((doc[who], th[who], at[who] + (head - base[own[head]]).astype(np.int32), (tail - head + 1).astype(np.int32)))
        d, t, a, m = (np.concatenate(x) for x in zip(*out))
        yield {"doc": d, "th": t, "at": a, "n": m}

    every = arrow(places, docs, "sk long, s2 int, doc long, th long, at int, n int")
    hit = every.join(known, ["sk", "s2"]).where("lo is null or lo < doc").select("doc", "th", "at", "n", "low")
    per = gathered(arrow(runs, hit, "doc long, th long, at int, n int"))
    for m in (marks, heat, chosen, many, wanted, firsts):
        m.drop()
    return per, copies.later


def _finish(n: int):
    def fn(b):
        data, off = text_buffer(b["text"])
        has = "at" in b.schema.names
        copy = b["copy"].fill_null(False).to_numpy(zero_copy_only=False) if has else np.zeros(b.num_rows, bool)
        size, removed, spans, sha = [], [], [], []
        for i in range(b.num_rows):
            raw = data[off[i]:off[i + 1]]
            gone = np.zeros(len(raw) + 1, np.int32)
            if copy[i] and len(raw) >= n:
                gone[0] += 1
            elif has and b["at"][i].is_valid:
                a, m = b["at"][i].values.to_numpy(), b["n"][i].values.to_numpy()
                np.add.at(gone, a, 1)
                np.add.at(gone, a + m - 1 + n, -1)
            out = np.cumsum(gone)[:-1] > 0
            size.append(len(raw))
            removed.append(int(out.sum()))
            spans.append(int((out & ~np.r_[False, out[:-1]]).sum()) if len(raw) else 0)
            sha.append(hashlib.sha256(raw[~out].tobytes()).hexdigest())
        yield {"doc_id": b["doc_id"], "n_bytes": size, "n_removed": removed, "n_spans": spans, "kept_sha256": sha}
    return fn


def dedup(docs: DataFrame, n: int = N, k: int = K, hot: int = HOT) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    own = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    per, later = repeats(keyed(docs), n, k, hot)
    joined, rest = marked_rows(own, per, later)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return arrow(_finish(n), joined, schema).unionAll(arrow(_finish(n), rest, schema))
