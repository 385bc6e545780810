"""Plain Python forms of the query contracts, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LAST = (1 << 63) - 1


def sha(b) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def secrets(rows):
    pats = (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    ok = {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    out = []
    for d, t in rows:
        spans = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(pats) for m in re.finditer(p, t or "") if ok[k](m))
        n = [sum(k == i for _, k, _ in spans) for i in range(3)]
        out.append((d, *n, sha(",".join(f"{pats[k][0]}:{s}:{e}" for s, k, e in spans))))
    return out


def decontaminate(rows, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = defaultdict(set)
    for i, t in items:
        w = word.findall(ascii_lower(t or ""))
        m = min(n, len(w))
        if m:
            for j in range(len(w) - m + 1):
                win[tuple(w[j:j + m])].add(i)
    lens = {len(k) for k in win}
    out = []
    for d, t in rows:
        w = word.findall(ascii_lower(t or ""))
        hit, ids = set(), set()
        for m in lens:
            for j in range(len(w) - m + 1):
                if (k := tuple(w[j:j + m])) in win:
                    hit.update(range(j, j + m))
                    ids |= {str(x) for x in win[k] if x is not None}
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def substring_words(rows, n=13):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    split = [(d if d is not None else LAST, word.findall(t or "")) for d, t in rows]
    for d, w in split:
        for j in range(len(w) - n + 1):
            k = tuple(w[j:j + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, w), (raw, _) in zip(split, rows):
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j:j + n])] < d:
                gone.update(range(j, j + n))
        out.append((raw, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def substring_bytes(rows, n=50):
    first = {}
    raw = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for j in range(len(b) - n + 1):
            k = b[j:j + n]
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, b), (own, _) in zip(raw, rows):
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j:j + n]] < d:
                gone[j:j + n] = b"\x01" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((own, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def near(rows, n=3, share=85):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in rows:
        w = word.findall(ascii_lower(t or ""))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for o in where[x]:
                if o > d:
                    shared[o] += 1
        for o, i in shared.items():
            if 100 * i >= share * (len(s) + len(sets[o]) - i):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return [(d, len(sets[d]), root(d), root(d) == d) for d, _ in rows]


def _upper_tail(z):
    import math
    return 0.5 * math.erfc(z / math.sqrt(2))


def secret_spans(rows, q=0.05, q_random=0.01):
    """(start, kind, end) of base and added spans by doc_id, by one pass of plain Python over each text."""
    import math

    from textloom.llm import secrets as S
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base, tests = {}, []
    for d, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        masked = t
        for a, _, e in spans:
            masked = masked[:a] + "\n" * (e - a) + masked[e:]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]{16,}", t)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", t)]
        base[d] = sorted(spans)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", masked):
            s = m[0]
            if re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", s):
                continue
            alphabet = next((a for _, p, a in S.ENCODINGS if re.search(p, s)), None)
            if alphabet is None:
                continue
            n, k, x = len(s), len(alphabet), [alphabet.index(c) for c in s]
            same = sum(s.count(c) * (s.count(c) - 1) for c in alphabet)
            mean, hi = sum(x) / n, sum(v >= k / 2 for v in x)
            runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
            two = 2 * hi * (n - hi)
            var = two * (two - n) / (n * n * (n - 1))
            zr = abs(runs - two / n - 1) / math.sqrt(var) if var > 0 else 99.0
            v2 = sum((v - mean) ** 2 for v in x)
            rho = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / v2 if v2 > 0 else 1.0
            cube = 2 / (9 * (k - 1))
            chi = max(0.0, (k * (same + n) / n - n) / (k - 1))
            p = min(_upper_tail((chi ** (1 / 3) - 1 + cube) / math.sqrt(cube)), 2 * _upper_tail(zr), 2 * _upper_tail(abs(rho * n + 1) / math.sqrt(n)))
            kappa = max(1.5 / k, 0.05)
            pt = _upper_tail((n * (n - 1) * kappa - same) / math.sqrt(2 * n * (n - 1) * kappa * (1 - kappa)))
            tests.append((0 if n < 24 else 1 if n < 32 else 2 if n < 48 else 3, min(1.0, 3 * p), pt, d, (m.start(), 3, m.end())))

    def cut(at, level):
        out = {}
        for c in {x[0] for x in tests}:
            bins = sorted((math.floor(-10 * math.log10(max(x[at], 1e-40))) for x in tests if x[0] == c), reverse=True)
            out[c] = max((10 ** (-b / 10) for b in set(bins) if 10 ** (-b / 10) * len(bins) / sum(y >= b for y in bins) <= level), default=0.0)
        return out

    random, text = cut(1, q_random), cut(2, q)
    for c, p, pt, d, span in tests:
        if p > random[c] and pt <= text[c]:
            base[d] = sorted([*base[d], span])
    return base


def mix(rows, weights=(5, 2, 1), passes=3):
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source): slots one by one."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = [(d, len(word.findall(t or "")), s) for d, t, s in rows]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in docs if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, rest = {}, set(names), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in left)
        full = [s for s in left if total and rest * weight[s] / total >= passes * size[s]]
        if not full:
            break
        for s in full:
            target[s] = float(passes * size[s])
        left -= set(full)
        rest = sum(size.values()) - sum(target.values())
    for s in left:
        target[s] = rest * weight[s] / sum(weight[x] for x in left)
    words = max(16, min(1024, sum(size.values()) // max(1, len(names) * 1024)))
    block = {s: max(1, min(words, int(target[s] // 64))) for s in names}
    due = {s: target[s] / block[s] for s in names}
    live, upto, at = [s for s in names if target[s] > 0], {}, 0.0
    for s in live:
        at += due[s]
        upto[s] = at
    got = dict.fromkeys(names, 0)
    for k in range(sum(-int(-due[s] // 1) for s in names) if live else 0):
        x = k * 0.6180339887498949 % 1.0
        s = next((s for s in live if x < upto[s] / at), live[-1])
        got[s] += block[s]
    out = []
    for s in names:
        own = sorted((hashlib.md5(("none" if d is None else str(d)).encode()).hexdigest(), (d is None, d or 0), n, d) for d, n, x in docs if x == s)
        start = 0
        for _, _, n, d in own:
            out.append((d, n, size[s], target[s], sum(min(n, max(0, got[s] - p * size[s] - start)) for p in range(passes))))
            start += n
    return out
