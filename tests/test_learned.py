"""What is learned from a corpus, against plain Python; sets of documents; byte pairs against the library."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import annotate, boundaries, index, language_model, ngrams, vocabulary
from textloom.plans import registry

DATA = "/root/testdata/sf0.001"


def plain_model(sents):
    """Probability of w after u, v."""
    c3 = Counter(t for s in sents for t in zip(["<s>", "<s>", *s], ["<s>", *s], s))
    c2 = Counter()
    for (u, v, w), c in c3.items():
        c2[v, w] += c if v == "<s>" else 1
    c1 = Counter(w for _, w in c2)
    disc = lambda c: n1 / (n1 + 2 * sum(x == 2 for x in c.values())) if (n1 := sum(x == 1 for x in c.values())) else 0.5
    d1, d2, d3 = disc(c1), disc(c2), disc(c3)
    by2, by3 = defaultdict(list), defaultdict(list)
    for (v, w), c in c2.items():
        by2[v].append(c)
    for (u, v, w), c in c3.items():
        by3[u, v].append(c)
    s1 = sum(c1.values())

    def p(u, v, w):
        one = max(c1[w] - d1, 0) / s1 + d1 * len(c1) / s1 / (len(c1) + 1)
        two = one if v not in by2 else max(c2[v, w] - d2, 0) / sum(by2[v]) + d2 * len(by2[v]) / sum(by2[v]) * one
        return two if (u, v) not in by3 else max(c3[u, v, w] - d3, 0) / sum(by3[u, v]) + d3 * len(by3[u, v]) / sum(by3[u, v]) * two
    return p


def test_trigram_model_equals_plain_python(spark):
    train = ["a b a c", "a b b a c a", "b a b", "c", "a b a c", "d a b c d"]
    held = ["a b a", "x a b", "c c x d", "d"]
    rows = lambda texts: [(i, 0, j, w) for i, t in enumerate(texts) for j, w in enumerate(t.split())]
    frame = lambda texts: spark.createDataFrame(rows(texts), "doc_id int, sent_id int, tok_i int, lemma string")
    p = plain_model([t.split() for t in train])
    for texts in (train, held):
        got = {r["doc_id"]: (r["n"], r["loss"]) for r in ngrams.sentence_loss(frame(texts), ngrams.fit(frame(train))).collect()}
        for i, t in enumerate(texts):
            w = t.split()
            want = [-math.log(p(*x)) for x in zip(["<s>", "<s>", *w], ["<s>", *w], w)]
            assert got[i][0] == len(w) and got[i][1] == pytest.approx(sum(want) / len(w), abs=1e-12)
    types = ["a", "b", "c", "d"]  # probabilities of a context add up to one, with one unknown
    for u, v in (("<s>", "<s>"), ("a", "b"), ("x", "a"), ("x", "y")):
        assert sum(p(u, v, w) for w in [*types, "unknown"]) == pytest.approx(1.0)


def test_trigram_loss_on_held_out_texts_is_below_the_bigrams(spark):
    tok = registry._tok(spark, DATA).select("doc_id", "sent_id", "tok_i", "lemma")
    train, held = tok.where("doc_id % 4 <> 1"), tok.where("doc_id % 4 = 1")
    total = lambda loss: loss.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("l")).first()["l"]
    three = total(ngrams.sentence_loss(held, ngrams.fit(train)))
    two = total(language_model.sentence_loss(held, language_model.fit(train)))
    print(f"held-out loss: three words {three:.3f}, two words {two:.3f}")
    assert three < two


def corpus():
    """Sentences with abbreviations, ordinals and ends."""
    lines = []
    for i in range(60):
        lines += [f"Das gilt z. B. für Patienten mit Fieber {i} und andere.", f"Der Termin ist am 3. Mai um neun Uhr im Haus {i}.", f"Many drugs, e.g. aspirin number {i}, help.",
                  f"Dr. Weber kam am Morgen. Der Arzt blieb bis zum Abend {i}.", "Es war kalt. Der Tag war lang. Danach kam der Regen.",
                  f"Wenn kalt und lang der Regen am Abend im Haus fällt, help andere weiter {i}"]
    return [(i, t) for i, t in enumerate(lines)]


def test_abbreviations_and_ordinals(spark):
    docs = spark.createDataFrame(corpus(), "doc_id int, text string")
    w = boundaries.words(docs)
    known = boundaries.abbreviations(w)
    got = {r["type"] for r in known.where("abbreviation").collect()}
    assert {"z", "b", "e.g", "dr"} <= got and not got & {"kalt", "lang", "regen", "abend", "haus", "help", "andere", boundaries.NUMBER}
    begin, pairs = boundaries.starters(w, known), boundaries.collocations(w, known)
    assert "der" in {r["type"] for r in begin.where("starter").collect()}
    assert (boundaries.NUMBER, "mai") in {(r["type"], r["next"]) for r in pairs.where("collocation").collect()}
    new = spark.createDataFrame([(1, "Das hilft z. B. bei Fieber. Am 3. Mai kam Dr. Weber. Danach ging er. So what? Yes! no end"), (2, ""), (3, None), (4, "Take it, e.g. Aspirin helps.")], "doc_id int, text string")
    s = boundaries.sentences(boundaries.words(new), known, begin, pairs)
    assert [r["sentence"] for r in s.where("doc_id = 1").orderBy("sent_id").collect()] == ["Das hilft z. B. bei Fieber.", "Am 3. Mai kam Dr. Weber.", "Danach ging er.", "So what?", "Yes!", "no end"]
    assert s.where("doc_id in (2, 3)").count() == 0
    assert [r["sentence"] for r in s.where("doc_id = 4").collect()] == ["Take it, e.g. Aspirin helps."]


def test_sentences_keep_every_word(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    w = boundaries.words(docs)
    known = boundaries.abbreviations(w)
    s = boundaries.sentences(w, known, boundaries.starters(w, known), boundaries.collocations(w, known))
    got = {r["doc_id"]: r["t"] for r in s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "sentence"))), lambda x: x["sentence"]), " ").alias("t")).collect()}
    want = {r["doc_id"]: " ".join(re.findall(r"[^ \t\n\r\f\x0b]+", r["text"])) for r in docs.collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_byte_pair_measures_equal_the_library(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 6000).select("doc_id", "text")
    tok = annotate.tokens(docs)
    got = {r["doc_id"]: r for r in vocabulary.byte_pair_metrics(annotate.sentences(docs), tok, docs, path).collect()}
    count = lambda t: len(Tokenizer_.encode(t, add_special_tokens=False).ids)
    Tokenizer_ = Tokenizer.from_file(path)
    n = {(r["doc_id"], r["sent_id"]): r["n"] for r in tok.groupBy("doc_id", "sent_id").agg(F.count("*").alias("n")).collect()}
    sents = defaultdict(list)
    for r in annotate.sentences(docs).collect():
        sents[r["doc_id"]].append((r["sent_id"], count(r["sentence"])))
    odd = defaultdict(list)
    for r in tok.where("not is_stop and not is_alpha").orderBy("doc_id", "sent_id", "tok_i").collect():
        odd[r["doc_id"]].append(r["text"])
    for r in docs.collect():
        d, t = r["doc_id"], r["text"].strip(" ")
        whole = count(t)
        assert got[d]["bpe_char_ratio"] == (pytest.approx(len(t) / whole) if whole else None)
        if sents[d]:
            assert got[d]["bpe_sentence_length"] == pytest.approx(sum(c for _, c in sents[d]) / len(sents[d]))
            assert got[d]["avg_bpe_length"] == pytest.approx(sum(c / n[d, s] for s, c in sents[d]) / len(sents[d]))
        if odd[d] and (c := count(" ".join(odd[d]))):
            assert got[d]["bpe_char_ratio_lex"] == pytest.approx(len(" ".join(odd[d])) / c)


def test_nested_sets_of_documents(spark, tmp_path):
    rows = [(1, "heart", "pain in the heart"), (2, "heart", "no pain"), (3, "lung", "pain in the lung"), (4, None, "the heart"), (5, "", None)]
    found = index.build(spark.createDataFrame(rows, "rowid long, title string, text string"), ("title", "text"), str(tmp_path / "i"))
    ask = lambda x: sorted(r["rowid"] for r in found.matching(x).collect())
    p = lambda text, col=None: ("phrase", col, text)
    assert ask(p("heart")) == [1, 2, 4] and ask(p("heart", "title")) == [1, 2]
    assert ask(("and", p("heart"), ("not", p("in the heart")))) == [2, 4]
    assert ask(("or", ("and", p("lung", "title"), p("pain", "text")), ("not", ("or", p("pain"), p("lung"))))) == [3, 4]
    assert ask(p('heart" OR title:(lung')) == [] and ask(p('"; DROP TABLE postings')) == [] and ask(p("((")) == []
    assert ask(("not", p("nothing"))) == [1, 2, 3, 4]
    for bad in (("xor", p("a"), p("b")), ("not", p("a"), p("b")), ("and",), ("phrase", "body", "a")):
        with pytest.raises(ValueError):
            found.matching(bad)


def test_statistics_of_words_come_from_one_table_of_counts(spark, capsys):
    from textloom.operators import boundaries
    df = spark.createDataFrame([(1, "Dr. Wu came. Then he left. Then he slept."), (2, "See p. 3. Then go. Dr. Wu"), (3, None), (4, "")], "doc_id int, text string")
    w = boundaries.words(df)
    counts = boundaries.counted(w)
    rows = lambda x: sorted(map(tuple, x.collect()))
    known = boundaries.abbreviations(w)
    assert rows(boundaries.abbreviations(w, counts)) == rows(known)
    assert rows(boundaries.starters(w, known, counts=counts)) == rows(boundaries.starters(w, known))
    assert rows(boundaries.collocations(w, known, counts=counts)) == rows(boundaries.collocations(w, known))
    capsys.readouterr()
    own = boundaries.abbreviations(w, counts)
    boundaries.starters(w, own, counts=counts).explain()
    boundaries.collocations(w, own, counts=counts).explain()
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_pieces_are_counted_where_texts_lie(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "One, two 12 three. Four four\n\t\nthe 5!"), (2, ""), (3, None), (4, "a")], "doc_id long, text string")
    rows = lambda tok: sorted(map(str, vocabulary.byte_pair_metrics(annotate.sentences(docs), tok, docs, path).collect()))
    assert rows(annotate.sentence_words(docs)) == rows(annotate.tokens(docs)) and len(rows(annotate.tokens(docs))) == 4
    plan = vocabulary.with_pieces(docs, "text", path, limit=1)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString() and plan.where("pieces > 0").count() == 2
