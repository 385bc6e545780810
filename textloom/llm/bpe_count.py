"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts are split at the special strings that the library takes whole, then by its pre-token pattern. Pre-tokens that
are not yet known to the worker are held together as one ragged numpy array of symbol numbers; in each step every
sequence finds its lowest-rank adjacent pair, all of its non-overlapping occurrences (left to right) merge at once,
and what survives when no pair is left is the count. A worker keeps at most ``KNOWN`` counts of earlier pre-tokens.

Null and empty texts have 0 bytes and 0 tokens. Each row is judged alone: repeated rows and null doc_id are kept.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow, text_buffer

LIMIT, KNOWN, GROUP = 1024, 400_000, 1 << 16
# Fixed value: the pre-token pattern of byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    """Pairs of symbols with rank and result, in an open-addressing table of numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], model["merges"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser is needed")
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(18, (4 * len(pairs) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, len(pairs), np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        key = (left << np.uint64(32) | right)
        at, todo = self._slot(key), np.arange(len(pairs))
        while len(todo):  # of those that want one slot the first gets it
            free = self.keys[at] < 0
            _, lead = np.unique(np.where(free, at, -1), return_index=True)
            lead = lead[free[lead]]
            self.keys[at[lead]], self.rank[at[lead]], self.made[at[lead]] = key[todo[lead]].view(np.int64), todo[lead], made[todo[lead]]
            rest = np.ones(len(todo), bool)
            rest[lead] = False
            todo, at = todo[rest], at[rest]
            taken = self.keys[at] >= 0
            at = np.where(taken, (at + 1) & ((1 << self.bits) - 1), at)
        self.none = len(pairs)
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Table slot of each pair; slots of no pair have rank ``none``."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at, want = self._slot(key), key.view(np.int64)
        got = self.keys[at]
        todo = np.flatnonzero((got != want) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            todo = todo[(got != want[todo]) & (got >= 0)]
        return at

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(len(raw)), size)
        out = size.copy()
        while len(sym) > 1:
            slot = self._find(sym[:-1], sym[1:])
            rank = np.where(row[:-1] == row[1:], self.rank[slot], self.none)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.append(rank, self.none), starts)
            live = best < self.none
            if not live.any():
                break
            per = np.diff(np.append(starts, len(sym)))
            hit = np.append(rank == np.repeat(best, per)[:-1], False) & np.repeat(live, per)
            # In a run of overlapping hits (x x x) every other one merges, from the left.
            at = np.flatnonzero(hit)
            fresh = np.r_[True, at[1:] != at[:-1] + 1]
            odd = (at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]) % 2
            at = at[odd == 0]
            sym[at] = self.made[slot[at]]
            keep = np.repeat(live, per)  # finished sequences leave the array
            keep[at + 1] = False
            done = row[starts[~live]]
            out[done] = per[~live]
            sym, row = sym[keep], row[keep]
        if len(sym):
            left = np.bincount(row, minlength=len(raw))
            out[left > 0] = left[left > 0]
        return out

    def learn(self, fresh: list[str]) -> None:
        if len(self.known) + len(fresh) > KNOWN:
            self.known.clear()
        for i in range(0, len(fresh), GROUP):
            part = fresh[i:i + GROUP]
            self.known.update(zip(part, self.counts(part).tolist()))

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, for texts of one bounded group."""
        pieces, extra = [], []
        for t in texts:
            n = 0
            if self.special and self.special.search(t):
                n = len(self.special.findall(t))
                got = [x for p in self.special.split(t) for x in self.split.findall(p)]
            else:
                got = self.split.findall(t)
            pieces.append(got)
            extra.append(n)
        known = self.known
        fresh = list({x for p in pieces for x in p if x not in known})
        if fresh:
            if len(known) + len(fresh) > KNOWN:
                known.clear()
                fresh = list({x for p in pieces for x in p})
            self.learn(fresh)
        get = self.known
        if len(get) < len(fresh):  # more distinct pre-tokens than a worker keeps: count them without keeping
            return [n + int(self.counts(p).sum()) if p else n for p, n in zip(pieces, extra)]
        return [n + sum(map(get.__getitem__, p)) for p, n in zip(pieces, extra)]


_MERGERS: dict[str, Merger] = {}


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The query's columns, one row per row of ``docs``. ``path``: the tokenizer file, present on every worker."""
    def fn(b):
        if path not in _MERGERS:
            _MERGERS[path] = Merger(path)
        data, off = text_buffer(b["text"])
        n_bytes, n_tokens, at = off[1:] - off[:-1], np.zeros(b.num_rows, np.int64), 0
        while at < b.num_rows:  # groups of about 1 MB of text
            to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1)
            part = b["text"].slice(at, to - at).to_pylist()
            n_tokens[at:to] = _MERGERS[path].texts([t or "" for t in part])
            at = to
        yield {"doc_id": b["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(fn, rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
