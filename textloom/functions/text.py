"""Text expressions: normalising, cleaning, splitting and formatting, as Column builders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\n+", "\n\n")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n\n+", "\n\n")


def edit_md_tables(c: Column) -> Column:
    """Separator rows of Markdown tables become a line break, cells lines of their own."""
    return F.regexp_replace(F.regexp_replace(c, r"(\| *-+ *)+\| *\n", "\n"), r" *\| *", "\n")


def strip_math(c: Column) -> Column:
    for pattern in (r"(?s)\$\$.*?\$\$", r"(?<!\$)\$(?!\$)[^$\n]+\$(?!\$)", r"(?s)\\\(.*?\\\)", r"(?s)\\\[.*?\\\]"):
        c = F.regexp_replace(c, pattern, "")
    return c


def markdown_text(md: str) -> str:
    """Plain text of Markdown: anchors stay, images, tables and math go, footnotes move to the end without numbers."""
    import re

    md = re.sub(r"\$\$.*?\$\$|(?<!\$)\$(?!\$)[^$\n]+\$(?!\$)|\\\(.*?\\\)|\\\[.*?\\\]", "", md or "", flags=re.S)
    notes, lines, fenced = [], [], False
    for line in md.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if not fenced:
            if m := re.match(r"\[\^[^\]]+\]:\s*(.*)", line):
                notes.append(m[1])
                continue
            if re.match(r"\s*\|.*\|\s*$", line) or re.match(r"\s*([-*_]\s*){3,}$", line):
                continue
            line = re.sub(r"^\s*(#{1,6}\s+|>+\s?|[-*+]\s+|\d+[.)]\s+)", "", line)
        lines.append(line)
    text = "\n".join(lines + notes)
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[\^[^\]]+\]", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(\*\*|__)(.+?)\1", r"\2"),
                        (r"(?<!\w)([*_])(.+?)\1(?!\w)", r"\2"), (r"`([^`]*)`", r"\1"), (r"[ \t]+", " ")):
        text = re.sub(pattern, by, text)
    return "\n\n".join(x for x in (y.strip() for y in text.split("\n")) if x)


def markdown_to_text(c: Column) -> Column:
    """Markdown needs a parser with state over lines, so this one is a batch UDF."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else markdown_text(x)), "string")(c)


def preprocess(c: Column, mode: str, markdown_input: bool) -> Column:
    if markdown_input:
        c = markdown_to_text(c) if mode == "strip" else edit_md_tables(c)
    return collapse_newlines(c)


def to_markdown(title: Column, paragraphs: Column) -> Column:
    texts = F.filter(F.transform(paragraphs, lambda p: p["text"]), lambda t: F.trim(t) != "")
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), title)), texts), "\n\n")


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(F.regexp_replace(c, r"\s+", " "))) > 0, F.lit(False))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+"))


def nfkd(c: Column) -> Column:
    """No built-in normalises to this form; a batch UDF does."""
    import unicodedata

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).strip())

    return F.pandas_udf(run, "string")(c)


def clean_query(c: Column) -> Column:
    return nfkd(F.translate(c, '"()', ""))


def query_phrases(c: Column) -> Column:
    """An array of phrases, any of which may match: the parts between commas."""
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")


def format_query(c: Column) -> Column:
    quoted = F.transform(query_phrases(c), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    return F.when(F.contains(c, F.lit(",")), F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")"))).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def strip_bracket(c: Column) -> Column:
    return F.regexp_replace(c, r"\s?\[[^\]]+\]$", "")


def split_ids(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def short_id(source: Column, article: Column) -> Column:
    """Article ids of sources that add language and view keep what stands before the first underscore."""
    return F.when(source.isin("apoum", "nhs"), article).otherwise(F.split_part(article, F.lit("_"), F.lit(1)))


def after_thinking(c: Column) -> Column:
    closed = F.element_at(F.split(c, "</think>"), -1)
    return F.trim(F.when(F.contains(c, F.lit("</think>")), closed).when(F.contains(c, F.lit("<think>")), "").otherwise(c))


# Verdicts in the order in which an answer is searched for them, and their spellings.
LABELS = ("richtig", "generalisierung", "spezialisierung", "falsch")
LABEL_SPELLINGS = {"richtig_1": "richtig", "richtig_2": "richtig", "Richtig": "richtig", "Falsch": "falsch", "False": "falsch", "Generalisierung": "generalisierung", "Spezialisierung": "spezialisierung"}


def parse_verdict(c: Column) -> Column:
    clean = F.lower(F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")))
    out = clean
    for label in reversed(LABELS):
        out = F.when(F.contains(clean, F.lit(label)), label).otherwise(out)
    return out


def normal_label(c: Column) -> Column:
    out = c
    for k, v in LABEL_SPELLINGS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def plot_title(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("--"), F.lit("–")), F.lit("\\%"), F.lit("%"))


def sig_marker(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def mean_sd(mean: Column, sd: Column, digits: int) -> Column:
    return F.when(mean.isNull() | sd.isNull(), "--").otherwise(F.format_string(f"%.{digits}f $\\pm$ %.{digits}f", mean, sd))


def percent_stars(ratio: Column, stars: Column) -> Column:
    return F.when(ratio.isNull(), "--").otherwise(F.concat(F.format_string("%+.0f\\%%", ratio), F.when(stars != "", F.concat(F.lit("$^{"), stars, F.lit("}$"))).otherwise("")))


def highlight_offsets(c: Column) -> Column:
    """(start, end) in the plain text of each ``<b>`` span of a highlighted one."""
    parts = F.split(c, "</b>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    def step(a, x):
        end = a["at"] + F.length(x) - 3
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.instr(x, "<b>") - 1).alias("s"), end.alias("e")))).alias("out"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda a: a["out"])


def render_prompt(template: str, c: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{TEXT}"), c)


def paragraph_choice(types: Column) -> Column:
    both = F.array_contains(types, "first-paragraph") & F.array_contains(types, "glance")
    return F.when(both, "_first-paragraph_glance").otherwise("_first-paragraph")


def comparison_name(file_name: str, suffixes: tuple[str, ...] = ("_keyness", "_comparison")) -> str:
    """The stem without one known ending."""
    stem = file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for s in suffixes:
        if stem.endswith(s):
            return stem[:-len(s)]
    return stem


def comparison_parts(name: str) -> tuple[str, str]:
    parts = name.split("-v-")
    if len(parts) != 2:
        raise ValueError(f"not of the form a-v-b: {name}")
    return parts[0], parts[1]
