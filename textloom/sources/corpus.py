"""Readers: corpus releases, frequency lists, metric tables, judgments, dictionaries, web pages, spreadsheets."""

from __future__ import annotations

import os
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The release's splits (source, subtree, language); the file is named after them.
SPLITS = (("msd", "professional", "de"), ("msd", "professional", "en"), ("msd", "amateur", "de"), ("msd", "amateur", "en"), ("msd", "short", "de"), ("msd", "short", "en"),
          ("gesund", "amateur", "de"), ("gesund", "amateur", "en"), ("nhs", "amateur", "en"), ("apoum", "amateur", "de"))
RECORD = ("source string, language string, instance_id string, article_id string, title string, subtree string, paragraphs array<struct<title:string,text:string>>, "
          "plain_text string, external_ids map<string,array<struct<value:string,distance:double>>>")


def file_name(source: str, subtree: str, language: str) -> str:
    return f"{source}_{subtree}_{language}.json"


def splits(spark: SparkSession, **want: str) -> DataFrame:
    rows = [(*s, file_name(*s)) for s in SPLITS]
    df = spark.createDataFrame(rows, "source string, subtree string, language string, filename string")
    for k, v in want.items():
        df = df.where(F.col(k) == v)
    return df


def split_for(source: str, subtree: str, language: str) -> str:
    if (source, subtree, language) not in SPLITS:
        raise KeyError((source, subtree, language))
    return file_name(source, subtree, language)


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's file systems, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def missing_files(spark: SparkSession, release: str) -> list[str]:
    return [n for s in SPLITS if not exists(spark, f"{release}/{(n := file_name(*s))}")]


def records(spark: SparkSession, release: str, **want: str) -> DataFrame:
    """All existing files of the chosen splits, read in one scan each and tagged by what their file name says."""
    out = None
    for source, subtree, language in SPLITS:
        own = {"source": source, "subtree": subtree, "language": language}
        path = f"{release}/{file_name(source, subtree, language)}"
        if any(own[k] != v for k, v in want.items()) or not exists(spark, path):
            continue
        df = spark.read.schema(RECORD).option("multiLine", True).json(path).withColumns({k: F.lit(v) for k, v in own.items()})
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], RECORD) if out is None else out


def texts(df: DataFrame) -> DataFrame:
    """Rows with text; white space alone passes."""
    return df.where(F.length("plain_text") > 0).select("article_id", "plain_text")


def titles(df: DataFrame, order: str) -> DataFrame:
    """Last title of each id."""
    return df.groupBy("instance_id").agg(F.max_by("title", order).alias("title"))


def trial_texts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("expert_abstract string, h2 string").option("multiLine", True).json(path)
    return df.select(F.explode(F.array(F.coalesce("expert_abstract", F.lit("")), F.coalesce("h2", F.lit("")))).alias("text")).where(F.length(F.trim("text")) > 0)


def abstract_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("abstract string").json(path).select(F.col("abstract").alias("text")).where(F.length(F.trim("text")) > 0)


def sentence_texts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*sentences.txt").text(path)
    parts = F.split(F.trim("value"), "\t")
    return df.select(F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0]).alias("text")).where("text <> ''")


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """``token, freq`` of a flat list or one nested under word forms or lemmas; other contents are errors."""
    flat, nested = "map<string,string>", "struct<word_freqs_lemma:map<string,string>,word_freqs_wordform:map<string,string>>"
    raw = spark.read.option("wholetext", True).text(path)
    n = F.from_json("value", nested)
    got = raw.select(F.coalesce(n["word_freqs_lemma"], n["word_freqs_wordform"], F.from_json("value", flat)).alias("m"))
    bad = F.raise_error(F.lit(f"no frequency list in {path}"))
    rows = got.select(F.explode(F.when(F.coalesce(F.size("m"), F.lit(0)) > 0, F.col("m")).otherwise(bad)).alias("token", "freq"))
    return rows.select("token", F.col("freq").cast("bigint").alias("freq"))


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated table as text; empty cells are empty strings, and words such as NA stay words."""
    df = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def simplifications(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, f"{folder}/simplifications_*.tsv").where(F.length(F.trim("simplified_text")) > 0)


def metric_registry(spark: SparkSession, path: str) -> DataFrame:
    """Validated, in the file's order. The registry is a small configuration file on the driver."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("metric", [])
    rows, seen = [], set()
    for i, m in enumerate(found):
        if m["key"] in seen or m["dir_key"] not in ("std", "llm", "jarg") or m.get("expected_sign", 0) not in (-1, 0, 1):
            raise ValueError(f"bad metric entry: {m}")
        seen.add(m["key"])
        rows.append((i, m["key"], m.get("title_en", m["key"]), m.get("title_de", m["key"]), m["dir_key"], m.get("expected_sign", 0), m.get("decimals", 2), float(m.get("scale", 1.0))))
    return spark.createDataFrame(rows, "pos int, key string, title_en string, title_de string, dir_key string, expected_sign int, decimals int, scale double")


def judgments(spark: SparkSession, path: str, labels: list[str], judges: list[str]) -> DataFrame:
    """Pairs of known articles with the chosen labels and judges, with their sources."""
    raw = spark.read.option("wholetext", True).text(path)
    doc = raw.select(F.from_json("value", "articles map<string,struct<source:string,titles:map<string,string>>>, pairs array<struct<a:string,b:string,label:string,judge:string,model:string,a_view:string,b_view:string>>").alias("j"))
    nodes = doc.select(F.explode("j.articles").alias("node", "x")).select("node", "x.source")
    pairs = doc.select(F.explode("j.pairs").alias("p")).select("p.*").where(F.col("label").isin(*labels) & F.col("judge").isin(*judges))
    a, b = (nodes.withColumnsRenamed({"node": x, "source": f"source_{x}"}) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def spreadsheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """Cells of a workbook's sheet as (row, column letter, value): the format is zipped XML, read by the standard library."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree as ET

    def cells(batches):
        for pdf in batches:
            out = []
            for blob in pdf["content"]:
                z = zipfile.ZipFile(io.BytesIO(blob))
                tag = lambda e: e.tag.rsplit("}", 1)[-1]
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
                for c in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter():
                    if tag(c) == "c":
                        v = "".join(x.text or "" for x in c.iter() if tag(x) in ("v", "t"))
                        col, row = re.match(r"([A-Z]+)(\d+)", c.attrib["r"]).groups()
                        out.append((int(row), col, shared[int(v)] if c.attrib.get("t") == "s" else v))
            yield pd.DataFrame(out, columns=["row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "row int, col string, value string")


def descriptor_terms(spark: SparkSession, path: str, only_prefix: str = "") -> DataFrame:
    """Descriptor records of an XML thesaurus, one row a term; a trailing bracket is stripped from names."""
    schema = ("DescriptorUI string, DescriptorName struct<String:string>, ConceptList struct<Concept:array<struct<ConceptUI:string,ConceptName:struct<String:string>,ScopeNote:string,"
              "TermList:struct<Term:array<struct<TermUI:string,String:string,_IsPermutedTermYN:string>>>>>>")
    df = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    note = F.element_at(F.filter(F.col("ConceptList.Concept.ScopeNote"), lambda n: n.isNotNull()), 1)
    c = df.select("DescriptorUI", F.regexp_replace("DescriptorName.String", r"\[[^\]]+\]$", "").alias("descriptor"), note.alias("scope_note"), F.explode("ConceptList.Concept").alias("c"))
    t = c.select("DescriptorUI", "descriptor", "scope_note", F.col("c.ConceptUI").alias("concept_ui"), F.regexp_replace("c.ConceptName.String", r"\[[^\]]+\]$", "").alias("concept"), F.explode("c.TermList.Term").alias("t"))
    return t.select(F.col("DescriptorUI").alias("descriptor_ui"), "descriptor", "scope_note", "concept_ui", "concept", F.col("t.TermUI").alias("term_ui"), F.col("t.String").alias("term"), F.col("t._IsPermutedTermYN").alias("is_permuted")).where(F.col("term_ui").startswith(only_prefix))


def supplemental(spark: SparkSession, path: str) -> DataFrame:
    schema = "SupplementalRecordUI string, Note string, HeadingMappedToList struct<HeadingMappedTo:array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>>, ConceptList struct<Concept:array<struct<ConceptUI:string,TermList:struct<Term:array<struct<TermUI:string>>>>>>"
    df = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(schema).load(path)
    return df.select(F.col("SupplementalRecordUI").alias("supp_ui"), F.transform("HeadingMappedToList.HeadingMappedTo", lambda h: F.ltrim(h["DescriptorReferredTo"]["DescriptorUI"], F.lit("*"))).alias("descriptor_ui"),
                     F.transform("ConceptList.Concept", lambda c: c["ConceptUI"]).alias("concept_ui"), F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["TermUI"]))).alias("term_ui"), F.col("Note").alias("note"))


def ontology_nodes(spark: SparkSession, path: str, prefix: str = "http://purl.obolibrary.org/obo/DOID_") -> DataFrame:
    """Nodes of an ontology graph with their names, synonyms, and cross references as a map, the last of a prefix winning."""
    raw = spark.read.option("wholetext", True).text(path)
    schema = "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<definition:struct<val:string>,synonyms:array<struct<val:string>>,xrefs:array<struct<val:string>>>>>>>"
    n = raw.select(F.explode(F.from_json("value", schema)["graphs"][0]["nodes"]).alias("n")).select("n.*").where(F.col("id").startswith(prefix) & F.col("meta").isNotNull())
    refs = F.aggregate(F.coalesce("meta.xrefs.val", F.array().cast("array<string>")), F.create_map().cast("map<string,string>"),
                       lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != F.split_part(x, F.lit(":"), F.lit(1))), F.create_map(F.split_part(x, F.lit(":"), F.lit(1)), F.split_part(x, F.lit(":"), F.lit(2)))))
    return n.select("id", F.col("lbl").alias("title"), F.col("meta.definition.val").alias("definition"), F.col("meta.synonyms.val").alias("synonyms"), refs.alias("xrefs"))


ICD = r"([A-Z]\d{2}(\.\d{1,4})?!?)\W"


def lexicon_pages(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("url string, title string, lex_info array<string>, text string").option("multiLine", True).json(path)
    info = F.map_from_entries(F.transform(F.filter("lex_info", lambda x: F.contains(x, F.lit(": "))), lambda x: F.struct(F.split_part(x, F.lit(": "), F.lit(1)), F.substring_index(x, ": ", -1))))
    return df.select(F.regexp_extract("url", r"([^/]+)/?$", 1).alias("id"), "title", info.alias("info"), F.array_join(F.regexp_extract_all("text", F.lit(ICD), F.lit(1)), ", ").alias("icd"), "text")


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, title, heading, text`` of web pages by the standard library's parser, in batches."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.title, self.heading, self.text = [], [], [], []

        def handle_starttag(self, tag, attrs):
            if tag not in ("br", "img", "meta", "link", "hr", "input"):
                self.stack.append(tag)
            if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3"):
                self.text.append("\n")

        def handle_endtag(self, tag):
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

        def handle_data(self, data):
            if "script" in self.stack or "style" in self.stack:
                return
            (self.title if "title" in self.stack else self.text).append(data)
            if "h1" in self.stack:
                self.heading.append(data)

    def read(batches):
        for pdf in batches:
            rows = []
            for i, h in zip(pdf[key], pdf[html]):
                r = Reader()
                r.feed(h or "")
                body = "\n".join(x for x in (" ".join(y.split()) for y in "".join(r.text).split("\n")) if x)
                rows.append((i, "".join(r.title).strip(), "".join(r.heading).strip(), body))
            yield pd.DataFrame(rows, columns=[key, "title", "heading", "text"])

    return pages.select(key, html).mapInPandas(read, f"{key} {dict(pages.dtypes)[key]}, title string, heading string, text string")


def embeddings(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Vectors of the right width, one a key: the last one by the order of files and lines."""
    df = spark.read.schema("key string, embedding array<float>").json(path).withColumn("_i", F.monotonically_increasing_id())
    df = df.withColumn("_f", F.input_file_name()).where(F.size("embedding") == dim)
    return df.groupBy("key").agg(F.max_by("embedding", F.struct("_f", "_i")).alias("embedding"))


def prompts(text: str) -> dict[str, tuple[str, str]]:
    """Pairs of system and user prompts by name, of a configuration file already read."""
    import yaml

    return {k: (v["sysprompt"].strip(), v["userprompt"]) for k, v in yaml.safe_load(text).items()}


def embed_batches(df: DataFrame, provider, key: str, text: str, batch: int = 32) -> DataFrame:
    """Vectors by a provider (list of texts to list of vectors), made once per task and called in batches."""
    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": provider(part[text].tolist())})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")
