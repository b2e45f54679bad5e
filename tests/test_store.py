"""The stored corpus: index, appends, types and sketches; groups; frequent n-grams."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import dictionary, frequency, ngram
from lexispark.operators.collocation import Collocates
from lexispark.operators.search import Hits
from lexispark.plans.corpus import Corpus
from lexispark.plans.store import Store, spans

WORDS = ["the", "cat", "Cats", "sat", "on", "of", "mat", "matting", ".", "7", "Dog", "runs", "running", "über"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tagged_units(spark, n, seed, first=0):
    r = random.Random(seed)
    units = []
    for k in range(n):
        tokens = [r.choice(WORDS) for _ in range(r.choice([0, 1, 5, 40, 90]))]
        tags = ["NN" if t[0] in "cCmMdD" else "VV" if t[0] in "srR" else "##" for t in tokens]
        units.append((first + k, r.choice(["en", "de", None]), "s", tokens, tags, [t.lower().rstrip("s") if tag != "##" else "##" for t, tag in zip(tokens, tags)]))
    return spark.createDataFrame(units, "unit_id long, lang string, source string, token array<string>, tag array<string>, lemma array<string>")


def corpus_of(units, **options):
    return Corpus.from_arrays(units, ["lang", "source"], **options)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two parts in a store, and all of it as one corpus; blocks so small that units have several."""
    path = str(tmp_path_factory.mktemp("store") / "s")
    a, b = tagged_units(spark, 60, 1), tagged_units(spark, 50, 2, 1000)
    options = {"block": 16, "halo": 12}
    store = Store.create(path, corpus_of(a.repartition(3), **options), ["lang"]).append(corpus_of(b, **options))
    return store, corpus_of(a.unionByName(b), **options), path


@pytest.mark.parametrize("query", ["the", "THE", "cat*", "*ing", "*a*", "m*t", "of the", "the cat* sat", "[cat]", "[*ing]", "[cat] [run*]", "_N*", "of _VV|NN", "[cat]_NN the", "* the", "*", "zzz", "zzz the", "[##]", "[*]", "[#*] the", "über", ""])
def test_index_finds_what_a_scan_finds(stored, query):
    store, corpus, _ = stored
    columns = ["unit_id", "lang", "pos", "len"]
    assert rows_of(store.positions(query).select(columns)) == rows_of(Hits(corpus, query).positions().select(columns))
    assert rows_of(Hits(store.narrow(query), query).positions().select(columns)) == rows_of(Hits(corpus, query).positions().select(columns))


@pytest.mark.parametrize("options", [{}, {"limit": 3}, {"limit": None}, {"limit": 7, "sample_seed": 5}, {"limit": 4, "near": "c*", "window": 3}, {"limit": 5, "show_tag": True, "show_lemma": True}])
def test_lines_from_the_store(stored, options):
    store, corpus, _ = stored
    options = {"left": 4, "right": 5, **options}
    for query in ("the", "of the", "[cat]", "_N* the"):
        assert rows_of(store.kwic(query, **options)) == rows_of(Hits(corpus, query).kwic(**options))


def test_a_search_reads_only_blocks_that_match(spark, tmp_path):
    """Blocks that leave the scan, counted by Spark."""
    texts = [f"word{k % 7} filler text" + (" needle" if k == 333 else "") for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    store = Store.create(f"{tmp_path}/s", Corpus.from_text(docs))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def scanned(df):
            rows = df.collect()
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
            scans = [leaves.apply(i) for i in range(leaves.size())]
            return len(rows), sum(s.metrics().apply("numOutputRows").value() for s in scans if s.nodeName().startswith("Scan parquet") and "/blocks/" in s.relation().location().rootPaths().toString())

        found, blocks = scanned(Hits(store.narrow("needle"), "needle").positions())
        assert (found, blocks) == (1, 16)
        found, blocks = scanned(Hits(store.narrow("absent"), "absent").positions())
        assert (found, blocks) == (0, 0)
        assert scanned(store.positions("needle")) == (1, 0)
        found, blocks = scanned(Hits(store.narrow("word3"), "word3").positions())
        assert found == 86 and blocks <= 600
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert all("/blocks/" not in f for f in store.positions("filler text").inputFiles())


LISTS = {
    "frequency": lambda c: frequency.frequency(c, tagged=True), "frequency by": lambda c: frequency.frequency(c, by=["lang"]), "lower": frequency.frequency_lower, "summary": frequency.summary,
    "summary by": lambda c: frequency.summary(c, ["lang"]), "cloud": frequency.cloud_weights, "forms": lambda c: dictionary.forms(c, "cat"), "fallback": lambda c: dictionary.forms(c, "the"),
    "related": lambda c: dictionary.related(c, "mat"), "tags": lambda c: dictionary.word_tags(c, "cats"), "tagset": dictionary.tagset, "raw": frequency.raw_mode,
}


@pytest.mark.parametrize("name", LISTS)
def test_lists_of_a_store_equal_a_rebuild_and_read_types_only(stored, name):
    store, corpus, _ = stored
    answer = LISTS[name](store.corpus)
    assert rows_of(answer) == rows_of(LISTS[name](corpus))
    assert answer.inputFiles() and all("/types/" in f for f in answer.inputFiles())


def test_collocates_of_a_store(stored):
    store, corpus, _ = stored
    for by in ([], ["lang"]):
        for query in ("the", "[cat] *"):
            mine, plain = Collocates(store.narrow(query), query, 4, by=by), Collocates(corpus, query, 4, by=by)
            assert rows_of(mine.stats()) == rows_of(plain.stats())
    assert store.corpus.size == corpus.size == store.tokens and store.raw == corpus.raw


def test_an_unfinished_append_is_not_seen(spark, stored):
    store, corpus, path = stored
    spark.createDataFrame([("the", "the", "NN", "the", 5, "en")], "token string, low string, tag string, lemma string, n long, lang string").write.parquet(f"{path}/types/part=broken")
    again = Store(spark, path)
    assert again.corpus.size == corpus.size and rows_of(frequency.frequency_lower(again.corpus)) == rows_of(frequency.frequency_lower(corpus))
    with pytest.raises(ValueError):
        store.append(Corpus.from_text(spark.createDataFrame([(1, "x")], "doc_id long, text string")))


def test_sketches_roll_up(stored):
    store, corpus, _ = stored
    exact = {r["lang"]: r for r in frequency.summary(corpus, ["lang"]).collect()}
    for r in store.summary_estimate(["lang"]).collect():
        assert all(abs(r[c] - exact[r["lang"]][c]) <= 0.03 * exact[r["lang"]][c] + 1 for c in ("n_tokens", "n_types", "n_lemmas"))
    whole, direct = store.summary_estimate().first(), frequency.summary(corpus).first()
    assert whole["n_tokens"] == direct["n_tokens"] and abs(whole["n_types"] - direct["n_types"]) <= 1


def test_an_empty_store(spark, tmp_path):
    store = Store.create(f"{tmp_path}/s", corpus_of(tagged_units(spark, 0, 1)))
    assert store.positions("the").count() == 0 and store.kwic("the").count() == 0 and store.corpus.size == 0 and frequency.frequency(store.corpus).count() == 0
    more = store.append(corpus_of(tagged_units(spark, 9, 4)))
    assert more.positions("the").count() == Hits(corpus_of(tagged_units(spark, 9, 4)), "the").count


def test_spans():
    assert spans([]) == [] and spans([5, 3, 4]) == [(3, 5)] and spans([1, 100, 101]) == [(1, 1), (100, 101)]
    r = random.Random(1)
    ids = sorted(r.sample(range(10**6), 5000))
    ranges = spans(ids, 50)
    assert len(ranges) == 50 and all(any(a <= i <= b for a, b in ranges) for i in ids[::97]) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


# -- groups ---------------------------------------------------------------------------------------


def test_groups_equal_their_own_corpora(spark):
    units = tagged_units(spark, 40, 7)
    whole = corpus_of(units)
    for lang in ("en", "de", None):
        own = corpus_of(units.filter(F.col("lang").eqNullSafe(F.lit(lang))))
        for f in (
            lambda c, by: Collocates(c, "the", 3, by=by).stats(), lambda c, by: Collocates(c, "the", 3, by=by).top(4), lambda c, by: Hits(c, "c*").breakdown(by=by), lambda c, by: Hits(c, "the").summary(near="cat", by=by),
            lambda c, by: frequency.cloud_weights(c, by=by), lambda c, by: dictionary.forms(c, "cat", by=by), lambda c, by: frequency.frequency(c, by=by), lambda c, by: frequency.summary(c, by),
            lambda c, by: ngram.ngrams(c, 2, by=by), lambda c, by: ngram.ngrams(c.as_one_sequence(by), 3, by=by), lambda c, by: Collocates(c.as_one_sequence(by), "the", 3, by=by).stats(),
        ):
            mine = f(whole, ["lang"]).filter(F.col("lang").eqNullSafe(F.lit(lang))).drop("lang")
            assert rows_of(mine) == rows_of(f(own, []))


def test_examples_of_groups(spark):
    units = tagged_units(spark, 30, 8)
    for r in Collocates(corpus_of(units), "the", 3, by=["lang"]).examples(3).collect():
        assert r["node"].lower() == "the" and r["word"] in f"{r['left']} {r['right']}".lower().split()


# -- plans ----------------------------------------------------------------------------------------


def test_lines_are_sorted_without_arrays(spark):
    corpus = corpus_of(tagged_units(spark, 5, 1))
    for options in ({}, {"sample_seed": 3}, {"near": "c*"}, {"limit": 5000}):
        plan = Hits(corpus, "the").kwic(3, 3, **options)._jdf.queryExecution().optimizedPlan()
        sorts = []

        def walk(node, sorts=sorts):
            if node.nodeName() == "Sort":
                sorts.append(node.child().schema().treeString())
            for k in range(node.children().size()):
                walk(node.children().apply(k))

        walk(plan)
        assert sorts and not any("array" in s for s in sorts)


def test_frequent_ngrams(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(WORDS) for _ in range(60)) + f" rare{k} tail{k}" for k in range(40)]
    corpus = Corpus.from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for minimum, cells, depth in ((2, 1 << 22, 1), (5, 64, 2), (1, 16, 1), (3, 1 << 20, 2)):
        every = ngram.ngrams(corpus, 2).filter(F.col("frequency") >= minimum)
        assert rows_of(ngram.frequent(corpus, 2, minimum, cells=cells, depth=depth)) == rows_of(every)


def test_no_unit_is_lost_without_an_id(spark):
    corpus = Corpus.from_text(spark.createDataFrame([(None, "the a"), (1, "b the"), (None, "the c")], "doc_id long, text string"))
    assert sorted(x["right"] for x in Hits(corpus, "the").kwic(2, 2).collect()) == ["", "a", "c"]
