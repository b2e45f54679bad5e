import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.operators import dictionary, frequency, ngram
from lexispark.operators.collocation import Collocates
from lexispark.operators.search import Hits
from lexispark.plans.corpus import Corpus
from lexispark.plans.pattern import parse_term
from lexispark.sources import markup, parallel, plain

TEXT = "The cat sat on the mat. The dog, 3 cats and the cat%s sat."


def corpus(spark, *texts, **options):
    return Corpus.from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options)


def tagged(spark, rows, **options):
    frame = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "unit_id long, pos long, token string, tag string, lemma string")
    return Corpus.from_tokens(frame, raw=False, **options)


def test_tokenise_and_null(spark):
    rows = corpus(spark, "It's 5% off_line — ok", None, "").tokens("token").orderBy("unit_id", "pos").collect()
    assert [r["token"] for r in rows] == ["It", "'", "s", "5", "%", "off_line", "—", "ok"]


def test_frequency_drops_punctuation_and_numbers(spark):
    rows = {r["token"]: r["frequency"] for r in frequency.frequency(corpus(spark, TEXT)).collect()}
    assert rows["The"] == 2 and rows["the"] == 2 and "." not in rows and "3" not in rows and rows["%"] == 1


def test_terms():
    assert parse_term("Cat*").word == "cat*"
    assert (parse_term("[Have*]_V*").lemma, parse_term("[Have*]_V*").tag) == ("have*", "V*")
    assert parse_term("run_V*").tag == "V*" and parse_term("run_V*").word is None


def test_wildcards_are_literal_otherwise(spark):
    c = corpus(spark, "a.b axb a%b % ab")
    assert Hits(c, "a*b").count == 2  # axb, ab
    assert Hits(c, "%").count == 2
    assert Hits(c, "*").count == c.size


def test_search_sequence_and_kwic_clips(spark):
    lines = Hits(corpus(spark, TEXT), "the cat").kwic(2, 3).orderBy("pos").collect()
    assert [(r["left"], r["node"], r["right"]) for r in lines] == [("", "The cat", "sat on the"), ("cats and", "the cat", "% s sat")]


def test_structural_search_on_raw_is_empty(spark):
    assert Hits(corpus(spark, TEXT), "_N*").count == 0


def test_tag_and_lemma_search(spark):
    c = tagged(spark, [("Dogs", "NNS", "dog"), ("ran", "VVD", "run"), ("run", "NN", "run")])
    assert Hits(c, "[run]").count == 2 and Hits(c, "[run]_V*").count == 1 and Hits(c, "_N*|VVD").count == 3
    assert Hits(c, "dogs _VV*").count == 1


def test_pattern_filter_reports_hits_and_matches(spark):
    row = Hits(corpus(spark, TEXT), "the").summary(near="dog", window=2).first()
    assert (row["hits"], row["matches"]) == (4, 1)
    line = Hits(corpus(spark, TEXT), "the").kwic(near="d*", window=2).first()
    assert line["collocate"] == "dog"


def test_collocates_overlap_and_sides(spark):
    rows = {r["word"]: r for r in Collocates(corpus(spark, "x the y the z"), "the", 2).counts().collect()}
    assert (rows["y"]["obs_l"], rows["y"]["obs_r"]) == (1, 1) and rows["y"]["observed"] == 2
    assert rows["the"]["observed"] == 2


def test_collocation_examples_are_first_in_order(spark):
    c = corpus(spark, "b the a", "the a b")
    rows = {r["word"]: (r["unit_id"], r["pos"]) for r in Collocates(c, "the", 2).examples(5).collect()}
    assert rows["a"] == (0, 1)


def test_ngram_counts_sum(spark):
    c = corpus(spark, TEXT, "a b", "a")
    sizes = [r["n"] for r in c.tokens("token").groupBy("unit_id").agg(F.count("*").alias("n")).collect()]
    for n in (1, 2, 3):
        total = ngram.ngrams(c, n, drop_punct=False).agg(F.sum("frequency")).first()[0]
        assert total == sum(max(0, s - n + 1) for s in sizes)


def test_ngram_filters(spark):
    rows = ngram.ngrams(corpus(spark, TEXT), 2, {1: "The", 2: "cat*", 9: "zzz"}).collect()
    assert sorted(r["ngram"] for r in rows) == ["The cat", "the cat"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(block=st.integers(4, 40), halo=st.integers(4, 9))
def test_blocks_do_not_change_results(spark, block, halo):
    text = TEXT * 4
    whole, cut = corpus(spark, text), corpus(spark, text, block=block, halo=halo)
    for f in (lambda c: ngram.ngrams(c, 3).select("ngram", "frequency"), lambda c: Collocates(c, "the", 3).counts(), lambda c: Hits(c, "the cat").kwic(3, 3, limit=None).select("pos", "left", "node", "right")):
        assert sorted(map(tuple, f(whole).collect()), key=str) == sorted(map(tuple, f(cut).collect()), key=str)


def test_corpus_scope_crosses_units(spark):
    c = corpus(spark, "a b", "c d", block=3, halo=2)
    assert {r["ngram"] for r in ngram.ngrams(c.as_one_sequence(), 2).collect()} == {"a b", "b c", "c d"}
    assert {r["ngram"] for r in ngram.ngrams(c, 2).collect()} == {"a b", "c d"}


def test_too_wide_context_is_refused(spark):
    with pytest.raises(ValueError):
        Collocates(corpus(spark, "a b", block=8, halo=2), "a", 5)


def test_dictionary_forms_and_fallback(spark):
    c = tagged(spark, [("Thing", "NN", "thing"), ("things", "NNS", "thing"), ("odd", "NN", "##")])
    assert {(r["token"], r["frequency"]) for r in dictionary.forms(c, "THING").collect()} == {("thing", 1), ("things", 1)}
    assert [(r["token"], r["tag"]) for r in dictionary.forms(c, "odd").collect()] == [("odd", "##")]
    assert dictionary.forms(c, "absent").count() == 0


def test_vertical_defaults(spark):
    frame = spark.createDataFrame([(0, "the\tDT\tthe\ndog NN dog\ncat\tNN\n\nold")], "doc_id long, text string")
    rows = plain.vertical_corpus(frame).tokens("token", "tag", "lemma").orderBy("pos").collect()
    assert [(r["token"], r["tag"], r["lemma"]) for r in rows] == [("the", "DT", "the"), ("dog", "NN", "dog"), ("cat", "NN", "###"), ("old", "###", "###")]


def test_markup_sentences(spark):
    text = '<text lang="en"><sent n="4"><w pos="DT" lemma="the">The</w> <w type="NN">dog</w><w> </w></sent><sent>A & B</sent><sent n="x">c\td\te</sent></text>'
    rows = markup.markup_corpus(spark.createDataFrame([(1, text), (2, "<broken"), (3, "<p>only text</p>")], "doc_id long, markup string")).tokens("token", "tag", "lemma", "sent")
    got = [(r["unit_id"], r["token"], r["tag"], r["lemma"], r["sent"]) for r in rows.orderBy("unit_id", "pos").collect()]
    assert got == [
        (1, "The", "DT", "the", 4), (1, "dog", "NN", "##", 4), (1, "A", "##", "##", 1), (1, "&", "##", "##", 1), (1, "B", "##", "##", 1), (1, "c", "d", "e", 2),
        (3, "only", "##", "##", 1), (3, "text", "##", "##", 1),
    ]


def test_parallel_alignment(spark):
    s = spark.createDataFrame([(1, 1), (1, 2)], "unit_id long, sent_id long")
    t = spark.createDataFrame([(1, 2), (1, 3)], "unit_id long, sent_id long")
    assert {(r["sent_id"], r["missing_in"]) for r in parallel.alignment(s, t).collect()} == {(1, "target"), (3, "source")}


def test_persisted_blocks_read_back(spark, tmp_path):
    c = corpus(spark, TEXT)
    c.write(str(tmp_path / "blocks"))
    assert Corpus.read(spark, str(tmp_path / "blocks"), raw=True).size == c.size
