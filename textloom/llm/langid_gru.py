"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A forward and a backward GRU read a text, every byte gets a probability of each language, and a document gets the mean
over its bytes. Texts are read whole, in segments of ``SEG`` bytes that advance together; each direction first reads the
``LEAD`` bytes that lie before a segment (after it, for the backward one), so that states at its bytes know their
surroundings and memory is bounded at any length.

Training is backpropagation through time with Adam, on windows of ``FIT_SEG`` bytes at uniform places of the whole
texts of at most ``SAMPLE`` labelled documents, those of the smallest hashes of doc_id (ties: of the smallest hash of the
text); held-out documents are never among them. Workers draw ``DRAWS`` windows of each sampled text, so what reaches the
driver is bounded by the sample, however long the texts are. Only text and lang are learned from.

Null texts and texts without a letter are ``und`` with score 0; so is everything where nothing can be learned, as from
an empty table. A null doc_id counts as the empty string for the hold-out rule. Rows are judged one by one: repeated rows
are kept and get equal results, columns of other names are ignored (``accepted`` returns all columns as they are).
Languages that tie are won by the first in code-point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow, chunks, lowest, prepared, stored, text_buffer

HIDDEN, SEG, LEAD, BATCH, SAMPLE, DRAWS, STEPS, FIT_SEG, FIT_BATCH, RATE = 8, 160, 32, 1024, 3000, 12, 250, 64, 160, 0.03


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class BiGRU:
    """Weights: ``e`` input to gates by byte (update, reset, candidate), ``u`` state to gates, ``o`` states to labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 11):
        r = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"ef": f(257, 3 * hidden), "eb": f(257, 3 * hidden), "uf": f(hidden, 3 * hidden), "ub": f(hidden, 3 * hidden),
                  "o": f(2 * hidden, len(labels)), "c": np.zeros(len(labels), np.float32)}
        for k in ("ef", "eb"):
            self.p[k][256] = 0  # padding

    def _halved(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Weights with the halves of sigma(a) = (1 + tanh(a / 2)) / 2 folded into the two gates."""
        e, u = self.p["e" + side].copy(), self.p["u" + side].copy()
        e[:, :2 * self.h] *= 0.5
        u[:, :2 * self.h] *= 0.5
        return e, u

    def states(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States after each byte of segments ``x`` (time, segment), read in the given direction, and what led to them."""
        h, (e, u) = self.h, self._halved(side)
        T, B = x.shape
        out, s, kept = np.empty((T, B, h), np.float32), np.zeros((B, h), np.float32), []
        for t in range(T) if side == "f" else range(T - 1, -1, -1):
            a, b = e.take(x[t], axis=0), s @ u
            zr = (np.tanh(a[:, :2 * h] + b[:, :2 * h]) + 1) * 0.5
            bn = b[:, 2 * h:]
            n = np.tanh(a[:, 2 * h:] + zr[:, h:] * bn)
            kept.append((t, s, zr, n, bn))
            s = n + zr[:, :h] * (s - n)
            out[t] = s
        return out, kept

    def position_probs(self, x: np.ndarray, lead: int = 0) -> np.ndarray:
        """Probability of each language at each byte but the first and last ``lead``: (time, language, segment).

        The batch is the last axis: rows of gates are then contiguous, which numpy runs several times faster.
        """
        h, o = self.h, np.ascontiguousarray(self.p["o"].T)
        T, B = x.shape
        y = np.empty((T - 2 * lead, len(self.labels), B), np.float32)
        for side in "fb":
            e, u = self._halved(side)
            u, w = np.ascontiguousarray(u.T), np.ascontiguousarray(o[:, :h] if side == "f" else o[:, h:])
            s, a, b = np.zeros((h, B), np.float32), np.empty((3 * h, B), np.float32), np.empty((3 * h, B), np.float32)
            d = np.empty((h, B), np.float32)
            for t in range(T - lead) if side == "f" else range(T - 1, lead - 1, -1):
                a[:] = e.take(x[t], axis=0).T
                np.matmul(u, s, out=b)
                z, r, n, bn = a[:h], a[h:2 * h], a[2 * h:], b[2 * h:]
                zr = a[:2 * h]
                zr += b[:2 * h]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                r *= bn
                n += r
                np.tanh(n, out=n)
                np.subtract(s, n, out=d)
                d *= z
                np.add(n, d, out=s)
                if not lead <= t < T - lead:
                    continue
                if side == "f":
                    np.matmul(w, s, out=y[t - lead])
                else:
                    y[t - lead] += w @ s
        y += self.p["c"][:, None]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities over the bytes of each text."""
        n = len(off) - 1
        size = np.diff(off)
        segs = -(-size // SEG)
        row = np.repeat(np.arange(n), segs)
        first = off[row] + SEG * (np.arange(len(row)) - np.repeat(np.cumsum(segs) - segs, segs))
        total = np.zeros((n, len(self.labels)))
        padded = np.concatenate([np.zeros(LEAD, np.uint8), data, np.zeros(SEG + LEAD, np.uint8)])
        place = np.arange(SEG + 2 * LEAD)[:, None]
        for i in range(0, len(row), BATCH):
            f, r = first[i:i + BATCH], row[i:i + BATCH]
            x = padded[f[None, :] + place].astype(np.int64)  # place 0 is LEAD bytes before the segment
            at = f[None, :] + place - LEAD
            x[(at < off[r]) | (at >= off[r + 1])] = 256
            y = self.position_probs(x, LEAD)
            y *= (f[None, :] + place[:SEG] < off[r + 1])[:, None, :]
            np.add.at(total, r, y.sum(axis=0).T)
        return total / np.maximum(size, 1)[:, None]

    def gradients(self, x: np.ndarray, inside: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of the mean cross-entropy of all positions, by backpropagation through time."""
        h, p = self.h, self.p
        (sf, kf), (sb, kb) = self.states(x, "f"), self.states(x, "b")
        s = np.concatenate([sf, sb], axis=2)
        y = s @ p["o"] + p["c"]
        y -= y.max(axis=2, keepdims=True)
        y = np.exp(y)
        y /= y.sum(axis=2, keepdims=True)
        T, B, _ = y.shape
        picked = y[:, np.arange(B), target]
        loss = float(-(np.log(picked + 1e-9) * inside).sum() / inside.sum())
        d = y
        d[:, np.arange(B), target] -= 1
        d *= (inside / inside.sum())[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["c"] = np.tensordot(s, d, ([0, 1], [0, 1])), d.sum(axis=(0, 1))
        ds = d @ p["o"].T
        for side, kept, own in (("f", kf, ds[:, :, :h]), ("b", kb, ds[:, :, h:])):
            u, carry = p["u" + side], np.zeros((B, h), np.float32)
            gates, rows = np.empty((T, B, 3 * h), np.float32), g["e" + side]
            for t, before, zr, n, bn in reversed(kept):
                dh = own[t] + carry
                z, r = zr[:, :h], zr[:, h:]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                g["u" + side] += before.T @ db
                carry = dh * z + db @ u.T
                gates[t] = da
            flat = x.ravel()
            order = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
            rows[flat[order][starts]] = np.add.reduceat(gates.reshape(-1, 3 * h)[order], starts, axis=0)
            rows[256] = 0
        return loss, g

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 5) -> "BiGRU":
        """Adam with a falling rate on rows of ``windows`` (256: padding); each language is drawn equally often."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        by = [np.flatnonzero(target == c) for c in range(len(self.labels))]
        for step in range(1, steps + 1):
            lang = r.integers(0, len(self.labels), FIT_BATCH)
            picked = np.array([r.choice(by[c]) for c in lang])
            x = np.ascontiguousarray(windows[picked].T)
            inside = (x != 256).astype(np.float32)
            _, g = self.gradients(x, inside, target[picked])
            rate = RATE * (1 - step / (steps + 1))
            for k, w in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                w -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def _drawn(b: pa.RecordBatch):
    """``DRAWS`` windows of each text, at places drawn by its key; a text that fits into one window gives one."""
    data, off = text_buffer(b["text"])
    key = b["key"].to_numpy().view(np.uint64)
    out, lang, own = [], [], []
    for i in range(b.num_rows):
        t = data[off[i]:off[i + 1]]
        room = len(t) - FIT_SEG
        at = np.random.default_rng(int(key[i])).integers(0, room + 1, DRAWS) if room > 0 else [0]
        for a in at:
            out.append(t[a:a + FIT_SEG].tobytes())
        lang += [b["lang"][i].as_py()] * len(at)
        own += [int(key[i].view(np.int64))] * len(at)
    yield {"key": own, "lang": lang, "window": out}


def learn(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> BiGRU | None:
    """A network fitted on windows of at most ``sample`` texts; None if there is nothing to learn from.

    The keys of the sample are chosen without texts and broadcast (at most ``sample`` rows of two longs); a worker
    sends windows of the texts that they name. Equal keys are equal rows but for their other columns.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).select(
        F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)).alias("key"), F.xxhash64("text").alias("th"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    keys = lowest(rows.select("key", "th").distinct(), "key", sample)
    picked = rows.join(F.broadcast(keys), ["key", "th"]).select("key", "lang", "text")
    drawn = stored(arrow(_drawn, picked, "key long, lang string, window binary").distinct())
    got = drawn.orderBy("key", "lang", "window").limit(sample * DRAWS).toArrow()
    labels = sorted(set(got["lang"].to_pylist()))
    if not labels:
        return None
    windows = np.full((len(got), FIT_SEG), 256, np.int64)
    for j, t in enumerate(got["window"].to_pylist()):
        windows[j, :len(t)] = np.frombuffer(t, np.uint8)
    target = np.array([labels.index(x) for x in got["lang"].to_pylist()])
    return BiGRU(labels).fit(windows, target, steps if len(labels) > 1 else 0)


def _probabilities(net: BiGRU, texts: pa.Array) -> np.ndarray:
    """Of each text, about 1 MB of texts at once."""
    data, off = text_buffer(texts)
    out = np.zeros((len(texts), len(net.labels)))
    for i, j in chunks(off, 1 << 20):
        out[i:j] = net.documents(data[off[i]:off[j]], off[i:j + 1] - off[i])
    return out


def identify(docs: DataFrame, net: BiGRU | None = None) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    net = net or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def fn(b):
        net = shared.value
        letter = b["letter"].to_numpy(zero_copy_only=False)
        probs = _probabilities(net, b["text"])
        yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [net.labels[c] if ok else "und" for c, ok in zip(probs.argmax(axis=1), letter)],
               "score": np.where(letter, np.clip(probs.max(axis=1), 0, 1), 0.0)}

    return arrow(fn, rows, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs``, all columns as they are, without documents of no known language: no letters (null and empty texts among
    them), or no language with a mean probability of ``least``. An empty table, or one without languages to learn, gives
    no rows; repeated rows stay or go together."""
    net = learn(docs)
    if net is None:
        return docs.where(F.lit(False))
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def run(it):
        for b in it:
            if b.num_rows:
                yield b.filter(pa.array(_probabilities(shared.value, b.column(place)).max(axis=1) >= least))

    some = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return some.mapInArrow(run, some.schema)
