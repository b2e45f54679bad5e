"""What the reviewer of round 4 found."""

import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexispark import queries
from lexispark.operators import ngram
from lexispark.operators.search import Hits
from lexispark.plans import store
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import scratch
from lexispark.sources import markup

ODD = [
    "", " ", "\n\n", "\t", "\r", " ", "　", None, "a b c", "# a b c", "　#x\na b c", "a b c  ", "a b c\n \n ", " <x", "\n<x", "a b\x0bc", "a\x0bb\x0bc", "\x0ca b",
    "a b c\r", "a b c\r\nd e f\r\n", "a\tb\tc\nd\te\tf\r\n\r\n\r\n\r\n\r\n",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "web") for i, t in enumerate(ODD)] + [(900, "a b c", None, "web"), (901, "", None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "<p>")], "page_id long, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["format_detect", "markup_lang", "src_raw_tokens", "multi_source_union"])
def test_documents_without_words_and_odd_spaces_are_as_in_sql(spark, odd, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{odd}/{table}.parquet/*.parquet')")
    wanted = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = __spark_entry__.queries()[name](spark, odd).select(*columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(wanted.fetchall())


def test_marked_up_files_are_written_in_groups_and_dropped(spark, monkeypatch):
    """Groups of documents give the rows of all at once; no group's files stay, and the next group's don't lie beside them."""
    d = "/root/testdata/sf0.001"
    rows = lambda: Counter(tuple(r) for r in __spark_entry__.queries()["src_markup_split"](spark, d).collect())
    folders = lambda: {p for p in os.listdir(scratch(spark)) if p.startswith("split-")}
    before, whole, beside = folders(), rows(), []
    split = markup.split_sentences
    monkeypatch.setattr(markup, "split_sentences", lambda *a, **o: beside.append(folders() - before) or split(*a, **o))
    monkeypatch.setattr(queries, "SPLIT_BYTES", 200_000, raising=False)
    assert rows() == whole and [len(x) for x in beside] == [1, 1] and folders() == before


def test_no_rare_ngram_is_shuffled_however_full_the_marks_are(spark, monkeypatch):
    """The marks are few rows, so they go to the n-grams: these are never dealt by their cells, and come from one more read."""
    cut, made = ngram.cut, []
    monkeypatch.setattr(ngram, "cut", lambda df, *a: made.append(cut(df, *a)) or made[-1])
    words = [f"w{k % 37} w{k % 41} w{k % 43} w{k}" for k in range(400)] * 5
    corpus = Corpus.from_text(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"))
    every = {(r["ngram"], r["frequency"]) for r in ngram.ngrams(corpus, 3).collect() if r["frequency"] >= 6}
    for cells in (1 << 10, 1 << 25):
        monkeypatch.setattr(ngram, "FEW_CELLS", 3, raising=False)
        found = ngram.frequent(corpus, 3, 6, cells=cells)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["ngram"], r["frequency"]) for r in found.collect()} == every and every
        assert "LeftSemi" not in plan and made[-1].count() <= cells // 64


def test_packed_keys_are_counted_as_they_are():
    r = np.random.default_rng(1)
    hashes = np.concatenate([r.integers(-(2**63), 2**63 - 1, 3000), np.repeat(r.integers(-(2**63), 2**63 - 1, 500), 4), [0, 0, -1, -1, -1]])
    r.shuffle(hashes)
    batches = [pa.record_batch([pa.array(part)], names=["h"]) for part in np.array_split(hashes, 7)]
    packed = pa.Table.from_batches([b for some in (batches[:3], batches[3:]) for b in ngram._counted(3)(iter(some))]).sort_by("bucket")
    words = {}
    for b in ngram._full_cells(3, 1 << 12, 2)(iter(packed.to_batches(100))):
        for word, bits in zip(*(c.to_pylist() for c in b.columns)):
            words[word] = words.get(word, 0) | bits & (2**64 - 1)
    key, n = np.unique(hashes.view(np.uint64) >> np.uint64(24), return_counts=True)
    wanted = {int(k) >> 14 * row & (1 << 12) - 1 | row << 12 for k in key[n >= 3] for row in (0, 1)}
    assert {w << 6 | i for w, bits in words.items() for i in range(64) if bits >> i & 1} == wanted


def test_postings_are_dealt_by_ranges_of_the_counted_types(spark, monkeypatch, tmp_path):
    """No posting is made to find the ranges; a frequent term is dealt over several files, and every place is found."""
    monkeypatch.setattr(store, "RANGE_TOKENS", 500, raising=False)
    words = [" ".join(["the"] * 30 + [f"w{k % 97}", f"x{k}", "Éa", "zu"]) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    monkeypatch.setattr(type(docs), "repartitionByRange", None)  # it would make the postings once more
    made = store.Store.create(str(tmp_path / "s"), Corpus.from_text(docs))
    files = made._table("postings").filter("term = 'the'").select(F.input_file_name()).distinct().count()
    assert files > 1
    for query in ("the", "w5*", "éa zu", "x399"):
        expected = sorted(tuple(r) for r in Hits(made.corpus, query).positions().collect())
        assert sorted(tuple(r) for r in made.positions(query).collect()) == expected and expected
