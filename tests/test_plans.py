"""How often a corpus is read, and what corpora keep when they are joined, written or numbered."""

import random
import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexispark.operators import dictionary, frequency, ngram, structure
from lexispark.operators.collocation import Collocates
from lexispark.operators.search import Hits, translated
from lexispark.plans.corpus import Corpus
from lexispark.sinks import write_table
from lexispark.sources import markup, parallel


@pytest.fixture
def reads(spark, tmp_path):
    """A corpus over a text that is counted whenever a row of it is read."""
    texts = ["the cat sat on the mat", "a dog and the other cat", "the end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    counter = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    docs = spark.read.parquet(f"{tmp_path}/docs").mapInArrow(seen, "doc_id long, text string")
    return Corpus.from_text(docs), counter


@pytest.mark.parametrize("analysis", [
    frequency.summary, frequency.frequency, lambda c: frequency.cloud_weights(c), lambda c: dictionary.forms(c, "cat"), lambda c: Collocates(c, "the").stats(), lambda c: Collocates(c, "the").top(5),
    lambda c: Collocates(c, "the", word="c*", min_observed=2).stats(), lambda c: ngram.ngrams(c, 2), lambda c: Hits(c, "t*").breakdown(), lambda c: Hits(c, "the").summary(near="cat"),
    lambda c: Hits(c, "the").kwic(limit=None), lambda c: Collocates(c, "the").graph_nodes(5),
])
def test_an_analysis_is_lazy_and_reads_the_corpus_once(reads, analysis):
    corpus, counter = reads
    answer = analysis(corpus)
    assert counter.value == 0
    assert answer.collect()
    assert counter.value == 3


@pytest.mark.parametrize("analysis", [lambda c: Hits(c, "the").kwic(), lambda c: Hits(c, "the").kwic(limit=2, sample_seed=1), lambda c: Collocates(c, "the").examples(5)])
def test_lines_take_a_pass_and_a_fetch(reads, analysis):
    corpus, counter = reads
    answer = analysis(corpus)
    assert counter.value == 0
    assert answer.collect()
    assert counter.value == 6


def test_positions_and_one_sequence(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randrange(0, 30))) for _ in range(40)]
    corpus = Corpus.from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8, halo=4)
    whole = " ".join(t for t in texts if t).split()
    rows = corpus.positions().orderBy("global_pos").collect()
    assert [r["token"] for r in rows] == whole and [r["global_pos"] for r in rows] == list(range(len(whole)))
    one = corpus.as_one_sequence()
    assert [r["token"] for r in one.tokens("token").orderBy("pos").collect()] == whole
    lines = Hits(one, "a").kwic(4, 4, limit=None).collect()
    assert {r["pos"]: (r["left"], r["right"]) for r in lines} == {i: (" ".join(whole[max(0, i - 4) : i]), " ".join(whole[i + 1 : i + 5])) for i, w in enumerate(whole) if w == "a"}


def test_union_keeps_labels_and_types(spark):
    a = Corpus.from_text(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"))
    b = Corpus.from_text(spark.createDataFrame([("x", "the dog the")], "doc_id string, text string"))
    both = Corpus.union({"first": a, "second": b})
    assert sorted(tuple(r) for r in Hits(both, "the").positions().select("corpus", "unit_id", "pos").collect()) == [("first", "1", 0), ("second", "x", 0), ("second", "x", 2)]
    counted = {(r["corpus"], r["token"]): r["frequency"] for r in frequency.frequency(both, by=["corpus"]).collect()}
    assert counted == {("first", "the"): 1, ("first", "cat"): 1, ("second", "the"): 2, ("second", "dog"): 1}


def test_a_written_corpus_is_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat " * 9, "en"), (2, "der Hund", None), (3, "", "de")], "doc_id long, text string, lang string")
    corpus = Corpus.from_text(docs, keep=["lang"], block=8, halo=5)
    corpus.write(f"{tmp_path}/c", ["lang"])
    again = Corpus.read(spark, f"{tmp_path}/c")
    assert (again.block, again.halo, again.raw, again.size, again.keep) == (8, 5, True, 29, ["lang"])
    key = lambda c: sorted(tuple(r) for r in c.tokens("token").select("unit_id", "pos", "token").collect())
    assert key(again) == key(corpus)
    with pytest.raises(ValueError):
        Hits(again, "cat").kwic(9, 9)


def test_tables_are_saved(spark, tmp_path):
    rows = [('"', 1), (" a ", 2), ("\\", 3), ('x"y', 4), ("", 5)]
    df = spark.createDataFrame(rows, "token string, n long")
    write_table(df, f"{tmp_path}/csv", "csv")
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").fillna("", ["token"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    write_table(df, f"{tmp_path}/pq")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/pq").collect())) == sorted(rows)
    with pytest.raises(ValueError):
        write_table(df, f"{tmp_path}/x", "xlsx")


def test_structure_against_a_parser(spark):
    texts = [
        """<text lang='en' n="1 > 0"><!-- <hidden a="b"/> --><sent id='7'>a &lt; b</sent><w pos="N&amp;N" lemma='it"s'/>x</text>""",
        """<Köp größe="ä"><a/><a b = "c"  d='e'
        f=""/><![CDATA[<no x="y">]]></Köp>""",
        "<?xml version='1.0'?><r><s n='1'/><s n='2'/><s/></r>",
        """<!DOCTYPE r [ <!ELEMENT r (s)> <!-- ] --> <!ATTLIST s n CDATA "]>"> ]><r k="&#65;&#x42;&amp;#67; &#228;&#x1F600;&#65;"/>""",
    ]
    expected = {}
    for t in texts:
        for e in ET.fromstring(t).iter():
            for attr, value in e.attrib.items() or [(None, None)]:
                expected.setdefault((e.tag, attr), set()).add(value)
    got = structure.structure(spark.createDataFrame([(t,) for t in texts], "markup string"), "markup").collect()
    assert {(r["tag"], r["attr"]): (r["n_values"], r["values"]) for r in got} == {
        k: (len(v - {None}), ",".join(sorted(v - {None}))) for k, v in expected.items()
    }
    long = "<a " + " ".join(f'k{i}="{"v" * 50}"' for i in range(3000)) + ">"
    assert structure.structure(spark.createDataFrame([(long,)], "markup string"), "markup").count() == 3000


def test_many_values_do_not_meet_in_a_task(spark):
    df = spark.range(60_000).selectExpr("concat('<a id=\"', lpad(id, 6, '0'), '\" k=\"', id % 3, '\"/>') AS markup")
    got = {r["attr"]: r for r in structure.structure(df, "markup").collect()}
    assert got["id"]["n_values"] == 60_000 and got["id"]["values"] == ",".join(f"{i:06d}" for i in range(20)) and got["k"]["values"] == "0,1,2"
    plan = structure.structure(df, "markup")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tag" in plan and plan.count("Exchange") == 2  # dealt by bucket once, then merged


def test_the_last_translation_counts(spark):
    lines = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "unit_id long, sent_id long, node string")
    sentences = spark.createDataFrame([(1, 5, 0, "old"), (1, 5, 2, "new"), (1, 5, 1, "zzz")], "unit_id long, sent_id long, ordinal long, text string")
    assert sorted(r["translation"] for r in translated(lines, sentences).collect()) == ["TRANSLATION N/A", "new"]


def test_two_marked_up_sides(spark):
    source = spark.createDataFrame([(1, '<t><sent n="1">the cat</sent><sent n="2">a dog</sent></t>')], "doc_id long, markup string")
    target = spark.createDataFrame([(1, '<t><sent n="1">die Katze</sent><sent n="3">ein Hund</sent></t>')], "doc_id long, markup string")
    p = parallel.ParallelCorpus.from_markup(source, target)
    assert sorted((r["sent_id"], r["missing_in"]) for r in p.unaligned.collect()) == [(2, "target"), (3, "source")]
    assert {r["node"]: r["translation"] for r in p.kwic("cat|dog".split("|")[0]).collect()} == {"cat": "die Katze"}
    assert Hits(p.target(), "hund").count == 1


def test_markup_without_sentences(spark):
    whole = markup.markup_corpus(spark.createDataFrame([(1, "<t>one two</t>"), (2, "<t>broken")], "doc_id long, markup string"))
    assert [(r["unit_id"], r["token"], r["sent"]) for r in whole.tokens("token", "sent").orderBy("pos").collect()] == [(1, "one", 1), (1, "two", 1)]
    assert re.fullmatch(r"\d+", str(whole.size)) and whole.tokens().filter(F.col("unit_id") == 2).count() == 0


@pytest.mark.parametrize("size", [64, 700, 100_000])
def test_a_large_document_is_parsed_in_pieces(spark, tmp_path, size):
    """Files that Spark splits give what whole documents give: ordinals, counted ids, words, namespaces."""
    r = random.Random(3)

    def sent(k):
        head = r.choice([f' n="{k}"', "", ' n="x"', f" id='{k}'"])
        body = r.choice([f"word{k} &amp; <hi>x</hi> y", '<t:w pos="N" lemma="l">Foo</t:w> <w>bar</w>', "a\tb\tc\nd\te", "", "one<sentiment k='>'>two</sentiment>"])
        return f"<sent{head}>{body}</sent>" if body or k % 2 else f"<sent{head}/>"

    docs = {}
    for name, prolog, tail in (("a", "<?xml version='1.0'?>\n<!-- c -->\n<text xmlns:t='urn:t' lang=\"en\">\n<head>no</head>", "\n<sent/>\n</text>\n<!-- end -->\n"), ("b", "<text xmlns:t='urn:t'>", "</text>"), ("c", "<text xmlns:t='urn:t'>", "<note>tail</note>\n</text >\n")):
        docs[name] = prolog + "".join(sent(k) + r.choice(["", "\n", " junk "]) for k in range(60)) + tail
        (tmp_path / name).write_text(docs[name])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        split = markup.split_sentences(spark, str(tmp_path))
        got = {(x["doc"][-1], x["ordinal"]): (x["sent_id"], x["text"], x["token"], x["tag"], x["lemma"]) for x in split.collect()}
        corpus = markup.split_corpus(spark, str(tmp_path), block=16, halo=8)
        tokens = sorted((x["unit_id"][-1], x["pos"], x["token"], x["tag"], x["sent"]) for x in corpus.tokens().collect())
        tasks = spark.read.option("lineSep", "</sent>").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 3 if size < 1000 else tasks >= 1
    whole = spark.createDataFrame([(k, docs[name]) for k, name in enumerate("abc")], "doc_id long, markup string")
    assert got == {("abc"[x["unit_id"]], x["ordinal"]): (x["sent_id"], x["text"], x["token"], x["tag"], x["lemma"]) for x in markup.sentences(whole, "doc_id", "markup").collect()}
    assert tokens == sorted(("abc"[x["unit_id"]], x["pos"], x["token"], x["tag"], x["sent"]) for x in markup.markup_corpus(whole).tokens().collect())
