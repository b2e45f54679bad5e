"""What the queries of round 3's findings cost, and that their results stay."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.functions.text import sanitize_markup
from lexispark.llm import langid, stages, storage
from lexispark.operators.collocation import Collocates
from lexispark.plans.corpus import Corpus
from lexispark.sources import markup, plain


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def test_markup_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "<t><sent><w>a</w> <w>b</w></sent><sent n='9'>c d</sent></t>"), (2, "<t><s/></t>"), (3, None)], "doc_id long, markup string")
    corpus = markup.markup_corpus(rows)
    assert exchanges(corpus.tokens()) == 0
    assert [(r["unit_id"], r["pos"], r["token"], r["sent"]) for r in corpus.tokens().orderBy("unit_id", "pos").collect()] == [(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "c", 9), (1, 3, "d", 9)]


def test_a_batch_is_parsed_in_pieces():
    """However many documents a batch has, those of about PIECE bytes are in Python at a time."""
    one = b"<t><sent>" + b"<w>word</w>" * 5000 + b"</sent></t>"
    batch = pa.record_batch([pa.array(range(100)), pa.array([one, None] * 50)], names=["unit_id", "markup"])
    out = list(markup._parse(False)(iter([batch])))
    assert len(out) > 2 and max(b.nbytes for b in out) < 4 * markup.PIECE
    assert pa.concat_arrays([b.column("unit_id") for b in out]).to_pylist() == list(range(100))
    assert sum(len(unit[0]["token"]) for b in out for unit in b.column("s").to_pylist() if unit) == 50 * 5000


@pytest.mark.parametrize("trim", [True, False])
def test_markup_bytes_are_cleaned_like_columns(spark, trim):
    r = random.Random(1)
    parts = [*"ab&;#x \t\n\r\x0b\x0c\x00\x1f\x7f\x85é￾￿﾿퟿\U0001f600", "&amp;", "&x;", "&#1;", "&abcdef;"]
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(1000)]
    column = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(sanitize_markup(F.col("t"), trim)).collect()
    assert [x[0] for x in column] == [markup.sanitized(t.encode(), trim).decode() for t in texts]


def test_a_declared_encoding_is_overruled(spark):
    rows = spark.createDataFrame([(1, "<?xml version='1.0' encoding='ISO-8859-1'?><t><sent>café</sent></t>")], "doc_id long, markup string")
    assert [r["text"] for r in markup.sentences(rows, "doc_id", "markup").collect()] == ["café"]


def test_a_vertical_line_is_split_once(spark):
    rows = spark.createDataFrame([(1, "a\tX\tl\r\nb\tY\n\nc\n\t\t\nd e f\n é\t\tm"), (2, None)], "doc_id long, text string")
    corpus = plain.vertical_corpus(rows)
    assert corpus.tokens()._jdf.queryExecution().optimizedPlan().toString().count("split(lambda") <= 2
    got = [(r["token"], r["tag"], r["lemma"]) for r in corpus.tokens().orderBy("unit_id", "pos").collect()]
    assert got == [("a", "X", "l"), ("b", "Y", "###"), ("c", "###", "###"), ("d", "e", "f"), (" é", "###", "m")]


def test_formats_are_told_from_one_pass(spark):
    texts = {"a\tb\tc": "vertical", "a\tb\tc\td\nx": "raw", "a b c\n# x\n\n  d  e  f ": "vertical", "a b c\nd e": "raw", "": "raw", "\t\t\nx": "raw", " <p>": "markup", "# a b c": "raw", "a b c d": "raw"}
    rows = spark.createDataFrame(list(texts.items()), "text string, format string").select("text", "format", plain.detect_format(F.col("text")).alias("got"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    assert [(r["text"], r["got"]) for r in rows.collect() if r["got"] != r["format"]] == []
    assert spark.createDataFrame([(None,)], "text string").select(plain.detect_format(F.col("text"))).first()[0] == "raw"


def test_pieces_are_numbered_where_they_are_parsed(spark, tmp_path):
    (tmp_path / "a").write_text("<t>" + "".join(f"<sent>w{k}</sent>" for k in range(40)) + "</t>")
    rows = markup.split_sentences(spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # over pieces, none over sentences
    assert [(r["ordinal"], r["sent_id"], r["token"]) for r in rows.orderBy("ordinal").collect()] == [(k, k + 1, [f"w{k}"]) for k in range(40)]


def test_one_sequence_gathers_only_what_is_read(spark):
    corpus = Corpus.from_text(spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")).as_one_sequence()
    gathered = re.findall(r"collect_list\(", corpus.tokens("token")._jdf.queryExecution().optimizedPlan().toString())
    assert len(gathered) == 1
    plan = corpus.tokens("token")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(##" not in plan


def exploded(df) -> int:
    """The rows that the plan's Generate nodes made when `df` was collected without adaptive plans."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        nodes, made = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            made += node.metrics().apply("numOutputRows").value() if node.nodeName() == "Generate" else 0
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        return made
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_counts_take_the_surroundings_of_matches_only(spark):
    rows = spark.createDataFrame([(1, "the cat " + "x " * 500), (2, "y " * 500), (3, "a the b")], "doc_id long, text string")
    found = Collocates(Corpus.from_text(rows), "the", window=1).counts()
    assert exploded(found) <= 10  # a block each, three neighbours and two matches; the totals would be a row for each of 1,005 tokens
    assert sorted((r["word"], r["obs_l"], r["obs_r"]) for r in found.collect()) == [("a", 1, 0), ("b", 0, 1), ("cat", 0, 1)]


def test_a_written_corpus_is_packed_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([(k, "the cat", f"l{k % 3}" if k % 4 else None) for k in range(40)], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    Corpus.from_text(rows, keep=["lang"]).write(str(tmp_path), ["lang"])
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert all(f.name.endswith(".zstd.parquet") for f in tmp_path.glob("blocks/*/*.parquet"))
    again = Corpus.read(spark, str(tmp_path)).blocks
    assert sorted((r["unit_id"], r["lang"]) for r in again.select("unit_id", "lang").collect()) == [(k, f"l{k % 3}" if k % 4 else None) for k in range(40)]


def test_examples_are_counted_without_a_sort(spark):
    rows = spark.createDataFrame([(3, "the cat the dog"), (None, "a cat the"), (2, "dog a the"), (1, "x y")], "doc_id long, text string")
    collocates = Collocates(Corpus.from_text(rows), "the", window=2)
    plan = collocates.stats(first=True)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    got = {r["word"]: (r["unit_id"], r["pos"], r["node"]) for r in collocates.examples(5).collect()}
    assert got == {"cat": (None, 2, "the"), "a": (None, 2, "the"), "dog": (2, 2, "the"), "the": (3, 0, "the")}


def test_stages_write_no_second_copy_of_stored_documents(spark, tmp_path, monkeypatch):
    words = random.Random(1)
    prose = lambda: " ".join(f"w{words.randrange(10**6)}" for _ in range(60))
    twice, leak = prose(), prose()
    rows = [(k, prose(), "x") for k in range(8)] + [(None, twice, "y"), (3, twice, "z"), (4, leak, "u")]
    spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    for stage, gone in ((stages.near_duplicates, (None, twice, "y")), (stages.decontaminate, (4, leak, "u"))):
        monkeypatch.setattr(storage, "shared_dir", lambda _, name=stage.__name__: f"{tmp_path}/{name}")
        out = stage(spark, docs, str(tmp_path), stored=True)
        assert out.columns == docs.columns
        assert {tuple(x) for x in out.collect()} == set(rows) - {gone} and out.count() == len(rows) - 1
        assert {p.parent.name for p in (tmp_path / stage.__name__).rglob("part-*")} == {"removed"}


def test_languages_are_labelled_in_small_slices_of_like_length(monkeypatch):
    """Python holds the words of half a MB of text at a time, and long texts don't hold up the short ones beside them."""
    texts = [("la casa " if k % 2 else "the house ") * (4000 if k % 10 == 0 else 20) for k in range(400)]
    seen = []
    label = lambda model, own, penalty: seen.append([len(t) for t in own]) or [(t[:2], 1.0, []) for t in own]
    monkeypatch.setattr(langid, "label_texts", label)
    batch = pa.record_batch([pa.array(range(401)), pa.array([*texts, None])], names=["_0", "_text"])
    out = pa.Table.from_batches(list(langid._predict(None, 1.0, ["_0"], 1)(iter([batch])))).to_pydict()
    assert dict(zip(out["_0"], out["lang_pred"], strict=True)) == {**{k: t[:2] for k, t in enumerate(texts)}, 400: ""}
    assert max(map(sum, seen)) <= 1 << 19
    assert sum(map(max, seen)) < 6 * max(map(max, seen))
