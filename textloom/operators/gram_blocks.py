"""Losses of sentences under n-gram counts of all texts, without a shuffle of places.

Texts are dealt out by key into parts of about ``PART`` characters. A part sends its distinct n-grams once, in arrays dealt
out by hash, to the tasks that add up the counts of all parts; these send the sums back in the order they came in, without
the n-grams. So what is shuffled grows with the distinct n-grams of a part instead of with places, and no task holds more than
a part or one share of what parts send.

Words are told apart by 64-bit hashes: among ten million types two are taken for one with probability below 3 in a million.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import annotate
from textloom.operators.staging import staged
from textloom.session import ship

PART, FAN = 1 << 24, 4
START, ANY = 0, 1  # no word's hash
CODED = "part INT, sent BINARY, size BINARY, codes BINARY, words BINARY"


def _hashes(words: pa.Array) -> np.ndarray:
    h = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words.to_pylist()), np.uint64).copy()
    h[h <= ANY] += np.uint64(2)
    return h


def _mixed(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        out = (out ^ k) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _coded(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts to one row: ``key`` of its texts, for each sentence with words its text, number and size, and the words.

    Rows that share a key are one text, whose tokens lie by sentence and place, as a window by key would have them.
    """
    them = [b for b in them if b.num_rows]
    if not any(len(b.column("words").flatten().flatten()) for b in them):
        return
    rows = pa.Table.from_batches(them)
    sents = [np.diff(c.offsets.to_numpy()) for c in rows.column("words").chunks]
    flat = [c.flatten() for c in rows.column("words").chunks]
    size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in flat]).astype(np.int64)
    tokens = pa.chunked_array([c.flatten() for c in flat], pa.string()).dictionary_encode().unify_dictionaries()
    codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in tokens.chunks]).astype(np.int32)
    words = tokens.chunk(0).dictionary
    keys = rows.column("key").combine_chunks().dictionary_encode("encode")
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    own = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.concatenate(sents)
    text = np.repeat(own, n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    if len(keys.dictionary) < len(own):
        at = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        codes = codes[np.lexsort((at, np.repeat(number, size), np.repeat(text, size)))]
        pair, inverse = np.unique(np.stack([text, number], 1), axis=0, return_inverse=True)
        size = np.bincount(inverse.ravel(), size, len(pair)).astype(np.int64)
        text, number = pair[:, 0], pair[:, 1]
    some = size > 0
    blob = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys.dictionary)], pa.int32()), keys.dictionary), pa.array([TaskContext.get().partitionId()], pa.int32()),
                                      blob(np.stack([text[some], number[some]]), np.int32), blob(size[some], np.int32), blob(np.stack([codes & 0xFFFF, codes >> 16]), np.uint16), blob(_hashes(words), np.uint64)],
                                     ["keys", "part", "sent", "size", "codes", "words"])


def coded(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keys`` and ``CODED``: one row a part, written once."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    # Small tables are dealt out over the session's tasks as well, if these get enough to do.
    parts = max(1, math.ceil(chars / PART), min(least, math.ceil(8 * chars / PART)))
    dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("_t")).repartition(parts, "key")
    # No test of the words here: it would be made before the texts are dealt out, by cutting them once more.
    sents = annotate.text_sentences(dealt, "key", "_t").select("key", F.transform("sents", lambda s: F.transform(s, F.lower)).alias("words"))
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return staged(sents.mapInArrow(_coded, f"keys ARRAY<{kind}>, {CODED}"))


class _Part:
    """What a coded row holds, as arrays."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], t)
        low, high = get("codes", np.uint16).reshape(2, -1).astype(np.int64)  # high halves are nearly all 0, so files and shuffles pack them
        self.part, self.codes, self.size = row["part"], high << 16 | low, get("size", np.int32).astype(np.int64)
        self.text, self.number = get("sent", np.int32).reshape(2, -1)
        self.hash = np.append(get("words", np.uint64), np.uint64(START))
        self.first = np.cumsum(self.size) - self.size

    def before(self, n: int) -> np.ndarray:
        """Codes of the words ``n`` before each place, or that of the start."""
        out = np.full(len(self.codes), len(self.hash) - 1, np.int64)
        out[n:] = self.codes[:-n] if n else self.codes
        for i in range(n):
            out[(self.first + i)[self.size > i]] = len(self.hash) - 1
        return out


def _share(keys: list[np.ndarray], shares: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by the share they are dealt to, the shares that get any, and where each begins."""
    share = (_mixed(*keys) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    found, first = np.unique(share[order], return_index=True)
    return order, found, np.append(first, len(order))


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint32 if len(b) == 4 * n else np.uint64).astype(np.int64)


def _rows(them: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in them:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


# ---- pairs ----------------------------------------------------------------------------------------

def _pairs(p: _Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct pairs (places of each, first and second code) and what is asked of all parts: counts of the pairs, of their
    first words and of all words."""
    v = len(p.hash)
    pair, inverse, n = np.unique(p.before(1) * v + p.codes, return_inverse=True, return_counts=True)
    a, b = pair // v, pair % v
    one, n1 = np.unique(p.before(1), return_counts=True)
    asked = [np.concatenate([p.hash[a], p.hash[one], np.full(v - 1, ANY, np.uint64)]), np.concatenate([p.hash[b], np.full(len(one), ANY, np.uint64), p.hash[:-1]])]
    return inverse, a, one, asked, np.concatenate([n, n1, np.ones(v - 1, np.int64)])


def _dealt(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Pairs of a first word go to ``FAN`` shares: so it repeats in a row, which packs well, and a frequent one is not in one task."""
    return [a, np.where(a == ANY, b, b % np.uint64(FAN))]


def _pairs_sent(shares: int):
    def batches(them):
        for row in _rows(them):
            *_, (a, b), n = _pairs(p := _Part(row))
            order, found, first = _share(_dealt(a, b), shares)
            for k, s in enumerate(found):
                o = order[first[k]:first[k + 1]]
                yield pa.RecordBatch.from_pylist([{"share": int(s), "part": p.part, "a": a[o].tobytes(), "b": b[o].tobytes(), "n": _narrow(n[o])}], SENT)
    return batches


SENT = pa.schema([("share", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
BACK = pa.schema([("part", pa.int32()), ("share", pa.int32()), ("total", pa.binary()), ("types", pa.int64())])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their keys, where each distinct one begins, and the number of each row's."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _pairs_summed(t: pa.Table) -> pa.Table:
    """One share of all parts: the sums for each part in its order; with no part, the number of types."""
    rows = t.to_pylist()
    a, b = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("a", "b"))
    sizes = [len(r["a"]) // 8 for r in rows]
    n = np.concatenate([_wide(r["n"], k) for r, k in zip(rows, sizes)])
    order, first, number = _groups(a, b)
    total = np.add.reduceat(n[order], first)[number]
    ends = np.cumsum(sizes)
    out = [{"part": r["part"], "share": r["share"], "total": _narrow(total[e - k:e]), "types": None} for r, k, e in zip(rows, sizes, ends)]
    return pa.Table.from_pylist([*out, {"part": -1, "share": rows[0]["share"], "total": None, "types": int((a[order][first] == ANY).sum())}], BACK)


def _lost(p: _Part, loss: np.ndarray, keys: pa.Array, schema: pa.Schema) -> pa.Table:
    """Mean losses of a part's sentences."""
    mean = np.add.reduceat(loss, p.first) / p.size
    return pa.Table.from_arrays([keys.take(pa.array(p.text)), pa.array(p.number), pa.array(p.size), pa.array(mean)], schema=schema)


def bigram_loss(docs: DataFrame, add: float = 0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sent_id, n, loss``: what ``language_model.sentence_loss`` gives for all tokens of the texts under their own model."""
    made = coded(docs, key, text)
    shares = made.count() or 1
    sent = made.drop("keys").mapInArrow(_pairs_sent(shares), "share INT, part INT, a BINARY, b BINARY, n BINARY")
    back = staged(sent.repartition(shares, "share").groupBy("share").applyInArrow(_pairs_summed, "part INT, share INT, total BINARY, types LONG"))
    types = back.agg(F.sum("types")).first()[0] or 0  # one number

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(key, left.schema.field("keys").type.value_type), ("sent_id", pa.int32()), ("n", pa.int64()), ("loss", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        p = _Part(left.drop_columns(["keys"]).to_pylist()[0])
        inverse, a, one, asked, _ = _pairs(p)
        order, found, first = _share(_dealt(*asked), shares)
        total = np.empty(len(order), np.int64)
        got = dict(zip(right.column("share").to_pylist(), right.column("total").to_pylist()))
        for k, s in enumerate(found):
            total[order[first[k]:first[k + 1]]] = _wide(got[int(s)], first[k + 1] - first[k])
        c1 = np.zeros(len(p.hash))
        c1[one] = total[len(a):len(a) + len(one)]
        loss = -np.log((total[:len(a)] + add) / (c1[a] + add * types))
        return _lost(p, loss[inverse.ravel()], left.column("keys").combine_chunks().flatten(), schema)

    kind = dict(docs.dtypes)[key]
    pairs = made.groupBy("part").cogroup(back.where("part >= 0").groupBy("part"))
    return pairs.applyInArrow(losses, f"{key} {kind}, sent_id INT, n LONG, loss DOUBLE")


# ---- triples ---------------------------------------------------------------------------------------

#: A round's rows to a share and from it: ``part`` is the one that asks or gets an answer, -1 for counts passed on to ``round``.
ROW = pa.schema([("round", pa.int32()), ("share", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("k0", "k1", "k2", "x0", "x1", "x2")), *((c, pa.int64()) for c in ("n1", "n2", "total", "types"))])
ROW_SQL = "round INT, share INT, part INT, k0 BINARY, k1 BINARY, k2 BINARY, x0 BINARY, x1 BINARY, x2 BINARY, n1 LONG, n2 LONG, total LONG, types LONG"


class _Triples:
    """A part's distinct triples, their pairs and its words, with what each round asks: keys and what these are dealt out by."""

    def __init__(self, p: _Part):
        size = len(p.hash)
        context, at = np.unique(p.before(2) * size + p.before(1), return_inverse=True)
        triple, self.places, self.n = np.unique(at.ravel() * size + p.codes, return_inverse=True, return_counts=True)
        u, self.v, self.w = context[triple // size] // size, context[triple // size] % size, triple % size
        pair, self.pair = np.unique(self.v * size + self.w, return_inverse=True)
        self.keys = {1: [p.hash[u], p.hash[self.v], p.hash[self.w]], 2: [p.hash[pair // size], p.hash[pair % size]], 3: [p.hash]}

    def dealt(self, round_: int) -> list[np.ndarray]:
        k = self.keys[round_]
        return k[:2] if round_ == 1 else _dealt(*k) if round_ == 2 else k


def _to_shares(round_: int, part: int, keys: list[np.ndarray], by: list[np.ndarray], values: list[np.ndarray], shares: int) -> Iterator[dict]:
    order, found, first = _share(by, shares)
    for k, s in enumerate(found):
        o = order[first[k]:first[k + 1]]
        yield {"round": round_, "share": int(s), "part": part} | {f"k{i}": x[o].tobytes() for i, x in enumerate(keys)} | {f"x{i}": _narrow(x[o]) for i, x in enumerate(values)}


def _asks(round_: int, shares: int):
    def batches(them):
        for row in _rows(them):
            t = _Triples(p := _Part(row))
            for r in _to_shares(round_, p.part, t.keys[round_], t.dealt(round_), [t.n] if round_ == 1 else [], shares):
                yield pa.RecordBatch.from_pylist([r], ROW)
    return batches


def _round(round_: int, shares: int):
    """One share of all parts: answers in each part's order, and what the next round adds up."""
    def summed(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        sizes = [len(r["k0"]) // 8 for r in rows]
        keys = [np.concatenate([np.frombuffer(r[f"k{i}"], np.uint64) for r in rows]) for i in range(4 - round_)]
        order, first, number = _groups(*keys)
        column = lambda x: np.concatenate([np.zeros(k, np.int64) if r[x] is None else _wide(r[x], k) for r, k in zip(rows, sizes)])
        sums = [np.add.reduceat(column(f"x{i}")[order], first) for i in range(3 if round_ == 3 else 1)]
        own = [k[order][first] for k in keys]
        answers, more = sums, []
        if round_ == 1:  # counts of triples, sums and types of their contexts; a pair has as many as words before it
            new = np.append(True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]))
            at, context = np.flatnonzero(new), np.cumsum(new) - 1
            answers = [sums[0], np.add.reduceat(sums[0], at)[context], np.diff(np.append(at, len(new)))[context]]
            o, f, _ = _groups(own[1], own[2])
            v, w = own[1][o][f], own[2][o][f]
            more = _to_shares(2, -1, [v, w], _dealt(v, w), [np.add.reduceat(np.where(own[1] == START, sums[0], 1)[o], f)], shares)
        elif round_ == 2:  # counts of pairs; sums and types after a word, types before one
            word, at = np.unique(np.concatenate(own), return_inverse=True)
            v, w = at.ravel()[:len(own[0])], at.ravel()[len(own[0]):]
            count = lambda x, n=None: np.bincount(x, n, len(word)).astype(np.int64)
            more = _to_shares(3, -1, [word], [word], [count(v, sums[0]), count(v), count(w)], shares)
        counts, out, end = sums[-1], [], 0
        for r, k in zip(rows, sizes):
            if r["part"] >= 0:
                out.append({"round": round_, "share": r["share"], "part": r["part"]} | {f"x{i}": _narrow(x[number[end:end + k]]) for i, x in enumerate(answers)})
            end += k
        out.append({"round": 0, "part": -1, "n1": int((counts == 1).sum()), "n2": int((counts == 2).sum()), "total": int(counts.sum()), "types": int((counts > 0).sum())})
        return pa.Table.from_pylist([*out, *more], ROW)
    return summed


def trigram_loss(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sent_id, n, loss``: what ``ngrams.sentence_loss`` gives for all tokens of the texts under their own model.

    Three rounds: triples with their contexts, pairs by the words before them, words by the words before them.
    """
    made = coded(docs, key, text)
    shares = made.count() or 1
    rounds, sizes = [], {}
    for r in (1, 2, 3):
        rows = made.drop("keys").mapInArrow(_asks(r, shares), ROW_SQL)
        if rounds:
            rows = rows.unionByName(rounds[-1].where(f"round = {r}"))
        rounds.append(staged(rows.repartition(shares, "share").groupBy("share").applyInArrow(_round(r, shares), ROW_SQL)))
        sizes[r] = rounds[-1].where("round = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "total", "types"))).first()
    discount = {r: s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] else 0.5 for r, s in sizes.items()}
    total, types = sizes[3]["total"], sizes[3]["types"]

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(key, left.schema.field("keys").type.value_type), ("sent_id", pa.int32()), ("n", pa.int64()), ("loss", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        p = _Part(left.drop_columns(["keys"]).to_pylist()[0])
        t = _Triples(p)
        got = {(r["round"], r["share"]): r for r in right.to_pylist()}

        def answer(round_: int, n: int) -> list[np.ndarray]:
            order, found, first = _share(t.dealt(round_), shares)
            out = [np.empty(len(order), np.int64) for _ in range(n)]
            for k, s in enumerate(found):
                for i, x in enumerate(out):
                    x[order[first[k]:first[k + 1]]] = _wide(got[round_, int(s)][f"x{i}"], first[k + 1] - first[k])
            return out

        (c3, s3, t3), (c2,), (s2, t2, c1) = answer(1, 3), answer(2, 1), answer(3, 3)
        below = np.maximum(c1[t.w] - discount[3], 0) / total + discount[3] * types / total / (types + 1)
        below = np.maximum(c2[t.pair.ravel()] - discount[2], 0) / s2[t.v] + discount[2] * t2[t.v] / s2[t.v] * below
        p3 = np.maximum(c3 - discount[1], 0) / s3 + discount[1] * t3 / s3 * below
        return _lost(p, -np.log(p3)[t.places.ravel()], left.column("keys").combine_chunks().flatten(), schema)

    answers = rounds[0].where("part >= 0")
    for r in rounds[1:]:
        answers = answers.unionByName(r.where("part >= 0"))
    kind = dict(docs.dtypes)[key]
    return made.groupBy("part").cogroup(answers.select("part", "round", "share", "x0", "x1", "x2").groupBy("part")).applyInArrow(losses, f"{key} {kind}, sent_id INT, n LONG, loss DOUBLE")
