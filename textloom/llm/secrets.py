"""Secret scans, by DataFrame functions alone.

Base spans come from three patterns. A randomness battery adds further spans: outside kept assignments, every run of
20 or more base-64-like characters that holds no hex or access match gets an inferred encoding and two p-values:

* ``p_random``, of the null "uniform random symbols of that encoding": the least of chi-squared uniformity over the
  alphabet (Wilson-Hilferty tail), runs about the middle of the alphabet and lag-1 serial correlation, times three.
* ``p_text``, of the null "structured text", whose symbols coincide at least as often as in prose: few coincidences.

Both are judged by the Benjamini-Hochberg rule within the run's class of lengths, as power grows with length: a run that
the battery rejects at level ``Q_RANDOM`` is not random; of the others, those whose text null is rejected at level ``q``
are added. So ``q`` bounds the share of text-like runs among those that pass on coincidences alone, and ``Q_RANDOM``
the share of random runs that are lost. The rule works on histograms of p-values over all documents (at most 401 bins
a class), so what reaches the driver is bounded.

Null text is empty; empty texts have no spans, an empty table gives an empty result. Repeated rows give repeated results,
rows that share a doc_id are told apart by their texts. Texts of any length are read whole, in time that grows with text
and matches. Columns beyond doc_id and text are ignored, and ``redact`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import keyed, packed, parted, stored

# Fixed values of the contract.
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# Encodings in order of inference: name, pattern of the whole run, its symbols in alphabet order.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
Q_RANDOM, Q = 0.01, 0.05
SPAN = "struct<start:int,kind:int,end:int,s:string,b0:int,b1:int>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that names a value, computed once, in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(rows: str, term: str, join: str, per: int = 256) -> str:
    """SQL for the fold of ``term`` (of ``x``) over the elements before each one: by chunks, then within a chunk.

    So no array grows element by element, and n elements cost n times half of ``per``.
    """
    fold = lambda part: f"aggregate({part}, 0, (a, x) -> {join.format('a', term)})"
    sums = f"transform(sequence(0, cast((size({rows}) - 1) div {per} as int)), c -> {fold(f'slice({rows}, c * {per} + 1, {per})')})"
    bases = f"aggregate({sums}, concat(cast(array() as array<int>), array(0)), (a, v) -> concat(a, array({join.format('element_at(a, -1)', 'v')})))"
    own = fold(f"slice({rows}, cast(i div {per} as int) * {per} + 1, cast(i % {per} as int))")
    return _let(bases, "bases", f"transform(sequence(0, size({rows}) - 1), i -> {join.format(f'bases[cast(i div {per} as int)]', own)})")


def _spans(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """SQL for an array of SPAN of the non-overlapping matches, in code points and in bytes: gaps and matches alternate.

    ``keep`` tests a match ``m``.
    """
    pat = "r'" + pattern.replace("'", r"\x27") + "'"
    z = (f"zip_with(split({text}, {pat}, -1), regexp_extract_all({text}, {pat}, 0), (g, m) -> named_struct("
         "'g', length(g), 'm', coalesce(length(m), 0), 'bg', octet_length(g), 'bm', coalesce(octet_length(m), 0), 's', m))")
    at = _running("z", "x.g + x.m", "{} + {}")
    by = f"if(octet_length({text}) = length({text}), at, {_running('z', 'x.bg + x.bm', '{} + {}')})"
    rows = (f"transform(z, (x, i) -> named_struct('start', at[i] + x.g, 'kind', {kind}, 'end', at[i] + x.g + x.m, 's', x.s, "
            "'b0', by[i] + x.bg, 'b1', by[i] + x.bg + x.bm))")
    kept = _let(z, "z", _let(at, "at", _let(by, "by", rows)))
    return f"filter({kept}, y -> {_let('y.s', 'm', f'm is not null and ({keep})')})"


def _blank(text: str, pattern: str, keep: str) -> str:
    """SQL for the text with its kept matches blanked, code point for code point."""
    pat = "r'" + pattern.replace("'", r"\x27") + "'"
    return (f"array_join(zip_with(split({text}, {pat}, -1), regexp_extract_all({text}, {pat}, 0), (g, m) -> "
            f"concat(g, if(m is null, '', if({keep}, repeat(chr(10), length(m)), m)))), '')")


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_base`` and ``_cand``: arrays of SPAN by start, then kind. One pass, no shuffle."""
    none = f"cast(array() as array<{SPAN}>)"
    words = " or ".join(f"contains(_l, '{k}')" for k in KEYWORDS)
    assign = ASSIGN.replace("'", r"\x27")
    # The pattern finds in a match what it found in the text, so group 2 is the value.
    keep = f"length(regexp_extract(m, r'{assign}', 2)) >= 6"
    # A hex match lies inside a candidate run, so one test guards both.
    step = docs.withColumn("_t", F.expr("coalesce(text, '')")).withColumn("_l", F.lower("_t")).withColumns({
        "_long": F.col("_t").rlike(CANDIDATE), "_word": F.expr(words), "_akia": F.expr("contains(_t, 'AKIA')")})
    step = step.withColumns({
        "_base": F.expr(f"array_sort(concat(if(_word, {_spans('_t', ASSIGN, 0, keep)}, {none}), "
                        f"if(_akia, {_spans('_t', ACCESS, 1)}, {none}), if(_long, {_spans('_t', HEX, 2)}, {none})))"),
        "_m": F.expr(f"if(_long and _word, {_blank('_t', ASSIGN, keep)}, _t)")})
    return step.withColumn("_cand", F.expr(f"if(_long, {_spans('_m', CANDIDATE, 3, f'not (m rlike {chr(39)}{HEX}|{ACCESS}{chr(39)})')}, {none})")).drop(
        "_t", "_l", "_long", "_word", "_akia", "_m")


def _tail(z: Column) -> Column:
    """Upper tail of the normal law: the density times a polynomial, from 2.5 on times a continued fraction.

    The relative error is below one in ten thousand throughout.
    """
    # Fixed values of the approximation.
    coefficients, scale = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.2316419
    x = F.abs(z)
    t = 1 / (1 + scale * x)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    deep = x
    for k in range(14, 0, -1):
        deep = x + k / deep
    p = F.exp(-x * x / 2) * 0.3989422804014327 * F.when(x < 2.5, poly).otherwise(1 / deep)
    return F.when(z >= 0, p).otherwise(1 - p)


def battery(runs: DataFrame, s: str = "s") -> DataFrame:
    """Adds encoding, len, p_random (Bonferroni over three tests) and p_text to rows with a run ``s``.

    Runs of no encoding get nulls. Costs alphabet-many passes over a run, so any length is fine.
    """
    enc, sym = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, symbols in reversed(ENCODINGS):
        enc = F.when(F.col(s).rlike(pattern), name).otherwise(enc)
        sym = F.when(F.col(s).rlike(pattern), symbols).otherwise(sym)
    df = runs.withColumns({"encoding": enc, "_sym": sym}).withColumns({
        "len": F.length(s).cast("double"), "_k": F.length("_sym").cast("double"),
        "_x": F.expr(f"if(_sym is null, null, transform(split({s}, ''), c -> cast(instr(_sym, c) - 1 as double)))")})
    df = df.withColumns({
        "_same": F.expr(f"aggregate(transform(split(_sym, ''), c -> length({s}) - length(replace({s}, c, ''))), 0D, (a, n) -> a + n * cast(n - 1 as double))"),
        "_mean": F.expr("aggregate(_x, 0D, (a, v) -> a + v) / len"),
        "_hi": F.expr("cast(size(filter(_x, v -> v >= _k / 2)) as double)"),
        "_runs": F.expr("1D + size(filter(sequence(1, size(_x) - 1), i -> (_x[i] >= _k / 2) <> (_x[i - 1] >= _k / 2)))")})
    n, k = F.col("len"), F.col("_k")
    lo = n - F.col("_hi")
    two = 2 * F.col("_hi") * lo
    run_var = two * (two - n) / (n * n * (n - 1))
    df = df.withColumns({
        "_var": F.expr("aggregate(_x, 0D, (a, v) -> a + (v - _mean) * (v - _mean))"),
        "_cov": F.expr("aggregate(sequence(1, size(_x) - 1), 0D, (a, i) -> a + (_x[i] - _mean) * (_x[i - 1] - _mean))"),
        # Chi-squared over its degrees of freedom: k/n times the sum of squared counts, less n.
        "_chi": (k * (F.col("_same") + n) / n - n) / (k - 1),
        "_zr": F.when(run_var > 0, F.abs(F.col("_runs") - two / n - 1) / F.sqrt(run_var)).otherwise(F.lit(99.0))})
    rho = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(F.lit(1.0))
    kappa = F.greatest(1.5 / k, F.lit(0.05))
    cube = 2 / (9 * (k - 1))  # Wilson-Hilferty: the cube root is nearly normal
    p = F.least(_tail((F.pow(F.col("_chi"), 1 / 3) - (1 - cube)) / F.sqrt(cube)), 2 * _tail(F.col("_zr")), 2 * _tail(F.abs(rho * n + 1) / F.sqrt(n)))
    text_z = (n * (n - 1) * kappa - F.col("_same")) / F.sqrt(2 * n * (n - 1) * kappa * (1 - kappa))
    return df.withColumns({"p_random": F.when(F.col("encoding").isNotNull(), F.least(F.lit(1.0), 3 * p)), "p_text": _tail(text_z)}).drop(
        "_sym", "_k", "_x", "_same", "_mean", "_hi", "_runs", "_var", "_cov", "_chi", "_zr")


def length_class() -> Column:
    n = F.col("len")
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).otherwise(3)


def cutoffs(tested: DataFrame, column: str, q: float) -> Column:
    """The p-value up to which a run's null is rejected in its class of lengths; 0 where none is."""
    p = F.greatest(F.col(column), F.lit(1e-40))
    bins = tested.where(F.col(column).isNotNull()).groupBy(length_class().alias("c"), F.floor(-10 * F.log10(p)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    rows = bins.collect()  # at most 4 * 401
    level = F.lit(0.0)
    for c in sorted({r["c"] for r in rows}):
        own, seen = sorted(((r["b"], r["n"]) for r in rows if r["c"] == c), reverse=True), 0
        total, best = sum(n for _, n in own), 0.0
        for b, n in own:
            seen += n
            if (edge := 10 ** (-b / 10)) * total / seen <= q:
                best = edge
        level = F.when(length_class() == c, F.lit(best)).otherwise(level)
    return level


def scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """``doc, th, doc_id, base, spans`` per row: arrays of SPAN without its text, spans by start, then kind.

    The texts are read once; base spans and runs, which are few, are stored. Runs are judged row by row of the
    run table and gathered per document, so a group is never larger than one document's own runs.
    """
    found = stored(with_spans(keyed(docs, "doc_id")).select("doc", "th", "doc_id", "_base", "_cand"))
    runs = found.where(F.size("_cand") > 0).select("doc", "th", F.explode("_cand").alias("run")).select("*", F.col("run.s").alias("s"))
    tested = stored(battery(runs.distinct()).select("doc", "th", "run", "len", "p_random", "p_text"))
    random = F.col("p_random") > cutoffs(tested, "p_random", Q_RANDOM)
    added = tested.where(random & (F.col("p_text") <= cutoffs(tested, "p_text", q))).groupBy("doc", "th").agg(F.collect_list("run").alias("_added"))
    bare = "x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'b0', x.b0, 'b1', x.b1)"
    return found.join(added, ["doc", "th"], "left").select(
        "doc", "th", "doc_id", F.expr(f"transform(_base, {bare})").alias("base"),
        F.expr(f"array_sort(transform(if(_added is null, _base, concat(_base, _added)), {bare}))").alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame, q: float = Q) -> DataFrame:
    """The query's columns, one row per row of ``docs``."""
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)")
    return scan(docs, q).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                                F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", q: float = Q) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; other texts, and all rows and columns, stay as they are.

    ``n_chars``, where there is such a column, follows the text. Only texts that may hold a span are shuffled.
    """
    hits = stored(scan(docs, q).where(F.size("spans") > 0).groupBy("doc", "th").agg(F.first("spans").alias("sp")))
    some, rest = parted(packed(docs), hits)
    # Overlapping spans merge: what follows a span starts at the largest end so far. Bytes are cut, so each cut is cheap.
    cut = "cast(substring(bin, {0} + 1, {1} - {0}) as string)"
    pieces = _let("cast(row.text as binary)", "bin", _let(_running("sp", "x.b1", "greatest({}, {})"), "far", (
        f"concat(array_join(transform(sp, (x, i) -> if(x.b0 >= far[i], concat({cut.format('far[i]', 'x.b0')}, '{mark}'), '')), ''), "
        f"{_let('aggregate(sp, 0, (a, x) -> greatest(a, x.b1))', 'last', cut.format('last', 'octet_length(bin)'))})")))
    new = some.join(hits, ["doc", "th"], "left").withColumn("new", F.expr(f"if(sp is null, row.text, {pieces})"))
    fields = lambda has: [(F.col("new") if has and c == "text" else F.length("new").cast(t) if has and c == "n_chars" else F.col("row").getField(c)).alias(c)
                          for c, t in docs.dtypes]
    changed = new.where("sp is not null").select(*fields(True))
    same = new.where("sp is null").select(*fields(False))
    return changed.unionAll(same).unionAll(rest.select(*fields(False)))
