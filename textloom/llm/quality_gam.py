"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over bins, learned by cyclic boosting: in turn, a shallow tree (two levels)
is fitted to the gradient over one feature's bins and added to its table. Then the pairs of features whose residual a
tree explains best get tables over pairs of bins in the same way. A document's score is the logistic of the sum of its
bins' entries. Features are counts over the whole text; labels, lang, source and doc_id are never among them.

Fitting uses at most ``SAMPLE`` labelled documents, those of the smallest hashes of doc_id, never held-out ones.
Null texts are empty; empty texts have features and a score like others. Where there is nothing to learn from, scores
are 0.5. A doc_id with several labels counts with the smallest. Rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.common import arrow, chunks, lowest, stored, text_buffer
from textloom.llm.langid_gru import held_out

SAMPLE, BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, CUT = 20_000, 32, 8, 120, 8, 60, 0.1, 0.7
FEATURES = ("bytes", "words", "word_bytes", "upper", "digit", "newline", "symbol", "exclaim", "stop", "high", "bar",
            "distinct_words", "top_word", "short_words", "distinct_lines", "repeated_lines", "line_bytes", "distinct_pairs", "entropy", "mixed_words")
_CLASS = np.zeros(256, np.uint8)  # 0 other white space and controls
for _chars, _n in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b"\n", 4), (b"#$%&*@^~<>{}[]\\/=+_`", 5),
                   (b"!?", 6), (b".,;:'\"()-", 7), (bytes(range(128, 256)), 8), (b"|", 9)):
    _CLASS[list(_chars)] = _n


def _share_distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct hashes in each row and the share of the most frequent one."""
    total = np.maximum(np.bincount(row, minlength=n), 1)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    starts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])][:len(r)])
    top = np.zeros(n)
    if len(starts):
        np.maximum.at(top, r[starts], np.diff(np.append(starts, len(r))))
    return np.bincount(r[starts], minlength=n) / total, top / total


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    at_least = np.maximum(size, 1)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10)
    hist = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) / at_least[:, None]
    entropy = -(hist * np.log2(np.where(hist > 0, hist, 1))).sum(axis=1)
    s, e, w = C.word_spans(data, off, ~C.SPACE_BYTES)
    words = np.bincount(w, minlength=n)
    h = C.span_hashes(data, s, e)
    distinct, top = _share_distinct(w, h, n)
    same = w[:-1] == w[1:] if len(w) else np.zeros(0, bool)
    pairs, _ = _share_distinct(w[:-1][same], C.grams(h, 2)[same] if len(h) > 1 else h[:0], n)
    short = np.bincount(w[(e - s) <= 3], minlength=n)
    # Words that end in a symbol or bar, or hold no letter.
    last = _CLASS[data[e - 1]] if len(e) else np.zeros(0, np.uint8)
    mixed = np.bincount(w[np.isin(last, (3, 5, 6, 9))], minlength=n)
    ls, le, lw = C.word_spans(data, off, np.arange(256) != 10)
    lines = np.maximum(np.bincount(lw, minlength=n), 1)
    lh = C.span_hashes(data, ls, le)
    line_distinct, line_top = _share_distinct(lw, lh, n)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
    d, one = at_least, np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.minimum((size - kinds[:, 4]) / one, 100), kinds[:, 2] / letters, kinds[:, 3] / d, kinds[:, 4] / d, kinds[:, 5] / d,
        kinds[:, 6] / d, kinds[:, 7] / d, kinds[:, 8] / d, kinds[:, 9] / d, distinct, top, short / one, line_distinct, line_top, np.log1p(size / lines), pairs, entropy, mixed / one])


def _tree(g: np.ndarray, h: np.ndarray, levels: int = 2) -> tuple[np.ndarray, float]:
    """Values over bins of a tree of so many levels, and its gain."""
    def split(a: int, b: int, level: int):
        G, H = g[a:b].sum(), h[a:b].sum()
        leaf = (np.full(b - a, -G / (H + 1.0)), G * G / (H + 1.0))
        if level == 0 or b - a < 2:
            return leaf
        cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gain = np.where((ch > 1) & (H - ch > 1), cg ** 2 / (ch + 1) + (G - cg) ** 2 / (H - ch + 1), -1)
        i = int(gain.argmax())
        if gain[i] <= leaf[1]:
            return leaf
        (x, gx), (y, gy) = split(a, a + i + 1, level - 1), split(a + i + 1, b, level - 1)
        return np.concatenate([x, y]), gx + gy
    return split(0, len(g), levels)


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The same over a grid: one split of either axis, then one of the other on each side."""
    best, gain = np.full(g.shape, -g.sum() / (h.sum() + 1)), g.sum() ** 2 / (h.sum() + 1)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for i in range(1, a.shape[0]):
            (x, gx), (y, gy) = _tree(a[:i].sum(0), b[:i].sum(0), 1), _tree(a[i:].sum(0), b[i:].sum(0), 1)
            if gx + gy > gain:
                v = np.vstack([np.tile(x, (i, 1)), np.tile(y, (a.shape[0] - i, 1))])
                best, gain = (v if axis == 0 else v.T), gx + gy
    return best, gain


class Gam:
    """Bin edges, a table for each feature, and tables for pairs of features over coarser bins."""

    def __init__(self, edges, coarse, tables, pairs, base):
        self.edges, self.coarse, self.tables, self.pairs, self.base = edges, coarse, tables, pairs, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        for (a, b), t in self.pairs.items():
            total += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Gam:
    cut = lambda f, k: np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1]))
    d = x.shape[1]
    edges, coarse = [cut(f, BINS) for f in range(d)], [cut(f, COARSE) for f in range(d)]
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    tables, total = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(d):
            g, h = slopes()
            k = len(tables[f])
            v, _ = _tree(np.bincount(fine[f], g, k), np.bincount(fine[f], h, k))
            tables[f] += RATE * v
            total += RATE * v[fine[f]]
    grid = lambda a, b, z: np.bincount(rough[a] * (len(coarse[b]) + 1) + rough[b], z, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)
    g, h = slopes()
    gains = sorted(((_tree2(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(d) for b in range(a)), reverse=True)
    pairs = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), t in pairs.items():
            g, h = slopes()
            v, _ = _tree2(grid(a, b, g), grid(a, b, h))
            t += RATE * v
            total += RATE * v[rough[a], rough[b]]
    return Gam(edges, coarse, tables, pairs, base)


def _vectors(b):
    data, off = text_buffer(b["text"])
    x = np.zeros((b.num_rows, len(FEATURES)))
    for i, j in chunks(off, 1 << 19):
        x[i:j] = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
    return x


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam | None:
    """The labels of the sample are at most ``sample`` rows, so they are broadcast; the texts stay where they are."""
    label = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("double").alias("y")).select(F.xxhash64("doc_id").alias("key"), "doc_id", "y"))
    label = lowest(label, "key", sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(label), "doc_id")
    schema = "key long, y double, " + ", ".join(f"{f} double" for f in FEATURES)

    def fn(b):
        x = _vectors(b)
        yield {"key": b["key"], "y": b["y"], **{f: x[:, i] for i, f in enumerate(FEATURES)}}

    # Rows that repeat a doc_id of the sample may exceed it: distinct ones, the smallest keys first, are taken.
    got = stored(arrow(fn, rows, schema).distinct()).orderBy("key", *FEATURES).limit(sample).drop("key").toPandas()
    got = got.sort_values(list(got.columns), kind="stable")  # the fit does not depend on the order of tasks
    if not len(got):
        return None
    return fit(got[list(FEATURES)].to_numpy(), got["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(b):
        s = shared.value.scores(_vectors(b)) if shared.value is not None else np.full(b.num_rows, 0.5)
        yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= cut).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow(fn, rows, "doc_id long, held_out boolean, score double, predicted int")
