"""MinHash near-dedup with circulant signatures.

A document's set holds the hashes of its distinct ``n``-word shingles. Two permutations make the whole signature: the
first places a shingle on a ring of ``RING`` slots, the second gives every slot a rank; coordinate i is the least rank
among the set's slots moved on by i. Coordinates are taken in ``BANDS`` bands of ``ROWS``: a pair at the threshold of
85 of 100 shares no band with probability (1 - 0.85**4)**24, below 3 in 100 million.

Documents of equal sets are one class, represented by the smallest doc_id. In each bucket of a band, every member is
checked against one centre, in ``rounds`` rounds with other centres; members that are by then in one component need no
more. In buckets that still hold two components or more, all pairs between components are compared by signature in
blocks of bounded size, and those whose estimate could reach the threshold are checked as well. So no bucket emits all
its pairs unless its members stay apart, and none is capped. Every link is confirmed on the full sets.

Null texts and texts without words have empty sets: they are linked with nothing. Rows that repeat a doc_id count as
one document with one component. Rows with a null doc_id are documents of their own, one for each text; a component
is named by its smallest doc_id, and one without any has component_id null and keeps one of its texts. Texts of fewer
than ``n`` words have one shingle; very long texts are read whole, and one text's set is the largest value of a row. Of
equal texts the one of the smallest doc_id stands for all. An empty table gives no rows; columns beyond doc_id and text
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.common import LAST_ID, arrow, bits_for, chunks, key_bitmap, packed, parted, passes, stored, text_buffer

N, SHARE = 3, 85
BANDS, ROWS = 24, 4
RING, CHUNK, BLOCK, LEAST = 1 << 17, 1 << 20, 512, 0.5
INSIDE = ~C.SPACE_BYTES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
RANK = np.random.default_rng(7).permutation(RING).astype(np.int32)
RANK = np.r_[RANK, RANK[:BANDS * ROWS]]


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, hash) of the distinct shingles of each row."""
    low = LOWER[data]
    s, e, row = C.word_spans(low, off, INSIDE)
    h = C.span_hashes(low, s, e)
    g = C.grams(h, n)
    ok = row[:len(g)] == row[n - 1:n - 1 + len(g)] if len(g) else np.zeros(0, bool)
    r, x = row[:len(g)][ok], g[ok]
    words = np.bincount(row, minlength=len(off) - 1)
    few = np.flatnonzero((words > 0) & (words < n))
    if len(few):  # the whole sequence is the only shingle
        first = np.searchsorted(row, few)
        p = C.prefix(h)
        y = C.mix((p[first + words[few]] - p[first]) * C._powers(len(h) + 1)[1][first] + words[few].astype(np.uint64))
        r, x = np.r_[r, few], np.r_[x, y]
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])][:len(r)]
    return r[new], x[new]


def signatures(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Signature of each row; rows without shingles get the largest rank throughout."""
    sig = np.full((n_rows, BANDS * ROWS), RING, np.int32)
    if len(rows):
        slot = (hashes >> np.uint64(64 - 17)).astype(np.intp)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        own = rows[starts]
        for i in range(BANDS * ROWS):
            sig[own, i] = np.minimum.reduceat(RANK[i:].take(slot), starts)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for i in range(ROWS):
            x = C.mix(x * C._P + sig[:, b * ROWS + i].astype(np.uint64))
        out[:, b] = x
    return out


def described(docs: DataFrame, n: int = N) -> DataFrame:
    """``doc, th, n, k1, k2, sig, own``: size of the set, its 128-bit key, the signature (binary) and the doc_id."""
    def fn(b):
        data, off = text_buffer(b["text"])
        doc, th = b["doc"].to_numpy(), b["th"].to_numpy()
        for i, j in chunks(off, CHUNK):
            r, x = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i], n)
            size = np.bincount(r, minlength=j - i)
            sig = signatures(r, x, j - i)
            at = np.r_[0, np.cumsum(size)]
            sums = []
            for salt in (1, 2):  # order-free keys of the set
                c = np.r_[np.uint64(0), np.cumsum(C.mix(x * C._P + np.uint64(salt)))]
                sums.append(C.mix(c[at[1:]] - c[at[:-1]] + size.astype(np.uint64)).view(np.int64))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * BANDS * ROWS), j - i, [None, pa.py_buffer(np.ascontiguousarray(sig))])
            yield {"doc": doc[i:j], "th": th[i:j], "n": size, "k1": sums[0], "k2": sums[1], "sig": flat.cast(pa.binary()), "own": b["own"].slice(i, j - i)}

    return arrow(fn, docs, "doc long, th long, n long, k1 long, k2 long, sig binary, own long")


def buckets(reps: DataFrame) -> DataFrame:
    """``band, doc, nth``: bucket keys of each representative; buckets of one are dropped before anything is joined."""
    def fn(b):
        sig = np.frombuffer(b["sig"].buffers()[2], np.int32)[b["sig"].offset * BANDS * ROWS:][:b.num_rows * BANDS * ROWS].reshape(b.num_rows, -1)
        yield {"band": band_keys(sig).ravel().view(np.int64), "doc": np.repeat(b["doc"].to_numpy(), BANDS), "nth": np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)}

    rows = arrow(fn, reps.select("doc", "sig"), "band long, doc long, nth int")
    full = rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(full.select("band"), "band", "left_semi")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``doc, set``: hashes of the representatives' shingles, for marked documents alone. ``wanted`` is a stored table."""
    key = wanted.select(F.xxhash64("doc").alias("key"))
    bits = bits_for(wanted.count())
    marks = docs.sparkSession.sparkContext.broadcast(key_bitmap(key, "key", bits))

    def fn(b):
        keep = passes(marks.value, b["key"].to_numpy(), bits)
        b = b.filter(pa.array(keep))
        if not b.num_rows:
            return
        data, off = text_buffer(b["text"])
        doc, th = b["doc"].to_numpy(), b["th"].to_numpy()
        for i, j in chunks(off, CHUNK):
            r, x = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i], n)
            at = np.r_[0, np.cumsum(np.bincount(r, minlength=j - i))].astype(np.int32)
            yield {"doc": doc[i:j], "th": th[i:j], "set": pa.ListArray.from_arrays(pa.array(at), pa.array(x.view(np.int64)))}

    got = arrow(fn, docs.select("doc", "th", "text", F.xxhash64("doc").alias("key")), "doc long, th long, set array<long>")
    out = stored(got.join(wanted, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select("doc", "set"))
    marks.destroy()
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. The side that may repeat is joined last and never grouped."""
    own = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    both = own.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= share * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def components(label: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``doc, comp`` after merging along ``links``: each comp becomes the smallest reachable one.

    ``label`` (doc, comp) and ``links`` (a, b, of docs) are stored tables. Links are first drawn between the labels that
    differ, so later rounds work on what is left; each one takes the least label of all neighbours, then jumps along the
    labels' own. After ``rounds`` of them labels may be larger than the least, but equal ones are always connected.
    """
    name = label.withColumnsRenamed({"doc": "b", "comp": "cb"})
    edge = links.join(label.withColumnRenamed("doc", "a"), "a").join(name, "b").where("comp <> cb").select(F.col("comp").alias("a"), F.col("cb").alias("b"))
    edge = stored(edge.unionAll(edge.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if not edge.limit(1).count():
        return label
    node = stored(edge.select(F.col("a").alias("doc"), F.col("a").alias("comp")).distinct())
    while rounds is None or rounds > 0:
        near = edge.join(node.withColumnsRenamed({"doc": "b", "comp": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = stored(node.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", "comp", F.least("comp", "c").alias("new")))
        # What a label's own node has found holds for all that carry the label.
        jump = step.select(F.col("doc").alias("new"), F.col("new").alias("to"))
        hook = step.where("new < comp").groupBy(F.col("comp").alias("root")).agg(F.min("new").alias("via"))
        moved = step.join(jump, "new", "left").join(hook, F.col("comp") == F.col("root"), "left").select(
            "doc", F.col("comp").alias("old"), F.least("new", F.coalesce("to", "new"), F.coalesce("via", "new")).alias("comp"))
        node = stored(moved)
        if not node.where("comp < old").limit(1).count():
            break
        node = node.select("doc", "comp")
        rounds = None if rounds is None else rounds - 1
    top = node.select(F.col("doc").alias("comp"), F.col("comp").alias("top"))
    return stored(label.join(top, "comp", "left").select("doc", F.coalesce("top", "comp").alias("comp")))


def links(reps: DataFrame, docs: DataFrame, n: int = N, share: int = SHARE, rounds: int = 3) -> DataFrame:
    """``doc, comp`` for the representatives that have any bucket: components of the confirmed links.

    Centres and counts of buckets are stored before they are joined, so that a large bucket's rows can be split.
    """
    band = stored(buckets(reps))
    info = reps.select("doc", "th", "n", "sig")
    comp = stored(band.select("doc").distinct().withColumn("comp", F.col("doc")))
    sets = sets_of(docs, stored(info.join(comp, "doc", "left_semi").select("doc", "th")), n)
    size = info.select("doc", "n")
    for r in range(rounds):
        live = band.join(comp, "doc")
        pick = F.min(F.struct(*([F.xxhash64("doc", F.lit(r))] if r else []), "doc", "comp")).alias("c")
        centre = live.groupBy("band").agg(pick, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        centre = stored(centre.select("band", F.col("c.doc").alias("centre"), F.col("c.comp").alias("cc")))
        pairs = live.join(centre, "band").where("comp <> cc").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        pairs = stored(in_reach(pairs, size, share))
        if not pairs.limit(1).count():
            break
        comp = components(comp, stored(confirmed(pairs, sets, share)), None if r + 1 == rounds else 2)
    live = band.join(comp, "doc")
    count = stored(live.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("band", "c"))
    if not count.limit(1).count():
        return comp
    rest = stored(blocked(live.join(count, "band").join(info.select("doc", "n", "sig"), "doc").join(sets, "doc"), share))
    return components(comp, rest)


def in_reach(pairs: DataFrame, size: DataFrame, share: int) -> DataFrame:
    """Pairs whose sizes allow the threshold."""
    na, nb = size.withColumnsRenamed({"doc": "a", "n": "na"}), size.withColumnsRenamed({"doc": "b", "n": "nb"})
    return pairs.join(na, "a").join(nb, "b").where(100 * F.least("na", "nb") >= share * F.greatest("na", "nb")).select("a", "b")


def blocked(members: DataFrame, share: int) -> DataFrame:
    """Pairs between components within each bucket that reach the threshold by their full sets.

    A bucket of c members has c / BLOCK blocks; each pair of blocks is a group of its own, at most two blocks large.
    A pair is compared once, in the first band that it shares, and only while its members are apart. Signatures spare
    most comparisons: pairs whose estimate is below ``LEAST`` are left out, which is nine standard deviations under the
    threshold.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "nth", "own", "doc", "comp", "n", "sig", "set")

    def pairs(t: pa.Table) -> pa.Table:
        i, j, nth, own = t["i"][0].as_py(), t["j"][0].as_py(), t["nth"][0].as_py(), t["own"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.int32).reshape(len(own), -1)
        doc, comp, n = t["doc"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy()
        sets = [x.values.to_numpy() for x in t["set"]]
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= share * np.maximum(n[right], n[x]))]
            if i == j:
                y = y[doc[y] > doc[x]]
            if not len(y):
                continue
            eq = sig[y] == sig[x]
            y = y[(eq.mean(axis=1) >= LEAST) & ~eq[:, :nth * ROWS].reshape(len(y), nth, ROWS).all(axis=2).any(axis=1)]
            mine = None
            for z in y.tolist():
                if (p := root(int(comp[x]))) == (q := root(int(comp[z]))):
                    continue
                mine = set(sets[x].tolist()) if mine is None else mine
                k = len(mine.intersection(sets[z].tolist()))
                if 100 * k >= share * (n[x] + n[z] - k):
                    up[max(p, q)] = min(p, q)
                    a.append(doc[x])
                    b.append(doc[z])
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("band", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def told_apart(docs: DataFrame, repeated: bool = False) -> tuple[DataFrame, bool]:
    """``doc, th, text, own`` (doc_id), and whether any ``doc`` is not the doc_id but a number made of the text's hash.

    Rows with a null doc_id, and with ``repeated`` those that share a doc_id, have such numbers, which no doc_id equals.
    """
    own, th = F.col("doc_id").cast("long"), F.xxhash64("text")
    rows = docs.select(own.alias("doc"), th.alias("th"), F.col("text").cast("string").alias("text"), own.alias("own"))
    ids = docs.select(own.alias("id"))
    many = stored(ids.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")) if repeated else None
    again = many is not None and bool(many.limit(1).count())
    if not again and not ids.where("id is null").limit(1).count():
        return rows, False
    if again:  # null ids are dealt out by their texts
        rows = rows.join(many, F.coalesce("doc", "th") == F.col("id"), "left")
    made = rows.withColumn("made", F.isnull("own") | (F.isnotnull("id") if again else F.lit(False))).drop("id")
    salt = 0
    while True:
        own_number = F.col("th").bitwiseXOR(F.lit(salt).cast("long"))
        marks = made.where("made").select(own_number.alias("doc")).distinct()
        if not made.where("not made").select("doc").join(marks, "doc", "left_semi").limit(1).count():
            return made.withColumn("doc", F.when(F.col("made"), own_number).otherwise(F.col("doc"))).select("doc", "th", "text", "own"), True
        salt += 1


def grouped(docs: DataFrame, n: int, share: int, repeated: bool = False) -> tuple[DataFrame, bool]:
    """``doc, th, n, own, comp``, one row per row of ``docs``, and whether numbers were made (see ``told_apart``)."""
    texts, made = told_apart(docs, repeated)
    rows = stored(described(texts, n))
    full = rows.where("n > 0")
    # Classes of copies are stored before the join, so that a large class's rows can be split.
    cls = stored(full.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc", "th")).alias("r")))
    rep = stored(full.join(cls, ["k1", "k2", "n"]).select("doc", "th", F.col("r.doc").alias("rep"), F.col("r.th").alias("rth")))
    first = rep.where("doc = rep and th = rth").select("doc", "th").distinct()
    comp = links(rows.join(first, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]), texts, n, share)
    # A doc_id on several texts ties their classes together.
    own = stored(rep.join(comp.withColumnRenamed("doc", "rep"), "rep", "left").select("doc", "th", F.coalesce("comp", "rep").alias("comp")).distinct())
    split = stored(own.groupBy("doc").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi"))
    if split.limit(1).count():
        tie = own.join(split, "doc").select(F.least("comp", "lo").alias("a"), F.greatest("comp", "lo").alias("b")).where("a < b").distinct()
        top = components(stored(own.select(F.col("comp").alias("doc"), "comp").distinct()), stored(tie)).withColumnsRenamed({"doc": "comp", "comp": "top"})
        own = own.join(top, "comp").select("doc", "th", F.col("top").alias("comp")).distinct()
    out = rows.select("doc", "th", "n", "own").join(own, ["doc", "th"], "left")
    return out.withColumn("comp", F.coalesce("comp", "doc")), made


def near_dedup(docs: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    out, made = grouped(docs, n, share)
    least, kept = F.col("comp"), F.col("doc") == F.col("comp")
    if made:  # the component is named by its smallest doc_id
        out = stored(out)
        out = out.join(out.groupBy("comp").agg(F.min("own").alias("least")), "comp")
        least, kept = F.col("least"), F.when(F.isnull("least"), kept).otherwise(F.coalesce(F.col("own") == F.col("least"), F.lit(False)))
    return out.select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("component_id"), kept.alias("kept"))


def representatives(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """``docs``, all columns as they are, with one row of each group of near copies: the one of the smallest doc_id, null
    ones last, ties by the hash of the text. Rows of no words (null and empty texts) stay; an empty table gives no rows.

    Texts alone make the groups: rows that share a doc_id, or have none, are grouped like those of different doc_ids.
    Texts that go without any tie are told by (doc_id, hash of the text), so they are not shuffled to be kept.
    """
    out, made = grouped(docs, n, share, repeated=True)
    rows = packed(docs)
    if not made:
        gone = stored(out.where("doc <> comp").select("doc", "th").distinct())
        some, rest = parted(rows, gone)
        return some.join(gone, ["doc", "th"], "left_anti").select("row.*").unionAll(rest.select("row.*"))
    out = stored(out.select(F.coalesce("own", F.lit(LAST_ID)).alias("doc"), "th", "n", "comp"))
    first = stored(out.where("n > 0").groupBy("comp").agg(F.min(F.struct("doc", "th")).alias("k")).select("k.*"))
    one = rows.join(first, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    bare = rows.join(out.where("n = 0").select("doc", "th").distinct(), ["doc", "th"], "left_semi")
    return one.select("row.*").unionAll(bare.select("row.*"))
