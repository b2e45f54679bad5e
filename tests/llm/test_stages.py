"""Pipeline stages on small tables made for them, against brute force."""

import random

from lexispark.llm import parity_join, stages


def near_copies(seed=5, n=40):
    """Pairs of 100 words that differ in two words far apart: five-word Jaccard 86/106, four-word 89/105."""
    r = random.Random(seed)
    texts = []
    for i in range(n):
        own = [f"w{r.randrange(10**6)}" for _ in range(100)]
        near = list(own)
        near[r.randrange(20, 40)], near[r.randrange(60, 80)] = f"x{i}", f"y{i}"
        texts += [" ".join(own), " ".join(near)]
    return texts


def brute_kept(texts, size, percent):
    """Ids of the smallest member of each component."""
    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return sorted(set(group))


def test_near_duplicates_between_the_thresholds(spark):
    r = random.Random(9)
    texts = near_copies()
    for _ in range(40):  # around the threshold, in lengths of several bands
        own = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(12, 400))]
        near = list(own)
        for _ in range(max(1, len(own) // 45)):
            near[r.randrange(len(near))] = f"z{r.randrange(10**6)}"
        texts += [" ".join(own), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in stages.near_duplicates(spark, docs, "").collect())
    assert kept == brute_kept(texts, 5, 80) and kept != brute_kept(texts, 4, 85)
    assert not set(range(1, 80, 2)) & set(kept)


def test_bands_leave_few_documents_open():
    """A band's smallest set misses fewer blocks than would open it, nearly always."""
    import numpy as np

    bands, r = parity_join.Bands(80), np.random.default_rng(1)
    bands.cover(5000)
    for n, d, k in list(zip(bands.start, bands.d, bands.k))[8:]:
        empty = [k - len(np.unique(r.integers(0, k, n))) for _ in range(50)]
        assert np.mean([e >= k - d for e in empty]) < 0.35


def test_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(3)
    a, b, c, d, leak = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (1, c), (1, d), (None, c), (2, leak), (None, leak + " x"), (7, a), (7, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    kept = sorted((tuple(x) for x in stages.near_duplicates(spark, docs, "").collect()), key=key)
    assert kept == sorted([(None, b), (1, c), (1, d), (2, leak), (7, a)], key=key)
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = sorted((tuple(x) for x in stages.decontaminate(spark, docs, str(tmp_path)).collect()), key=key)
    assert clean == sorted([x for x in rows if leak not in x[1]], key=key)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, row string, size string, shard string, kept0 string, lang_pred string, score double"


def odd_rows():
    """Null and repeated ids, null and blank texts, a very long one, and columns that operators have names for."""
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice("the house of a small town and its people were there when rain came".split()) for _ in range(n))
    rows = [(k, prose(r.randrange(20, 90))) for k in range(40)] + [(None, prose(30)), (None, prose(31)), (5, prose(40)), (5, prose(41)), (90, prose(60_000)), (91, None), (92, ""), (93, " \n "), (94, "123")]
    return [(i, t, "en", r.choice(["a", "b", None]), 7, f"r{k}", "x", "y", "z", "k", "p", 0.5) for k, (i, t) in enumerate(rows)]


def test_stages_keep_all_columns_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)
    spark.createDataFrame([(0, "some words that no document has in this order at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {x["_row"]: tuple(x) for x in docs.collect()}
    blank = {x["_row"] for x in docs.collect() if x["doc_id"] in (91, 92, 93, 94)}
    for stage in (stages.language_id, stages.near_duplicates, stages.decontaminate, stages.mix_sources):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(x) == rows[x["_row"]] for x in got)  # nothing renamed, overwritten or mixed up
        kept = {x["_row"] for x in got}
        if stage is stages.language_id:
            assert kept == set(rows) - blank
        elif stage is stages.decontaminate:
            assert kept == set(rows)
        elif stage is stages.near_duplicates:
            assert blank <= kept and len(got) == len(kept)
    sharded = stages.shard(spark, docs, "").collect()
    assert sorted(str(x["doc_id"]) for x in sharded) == sorted(str(x[0]) for x in rows.values())
    assert sum(x["size"] for x in sharded) == sum(len((x[1] or "").encode()) + 1 for x in rows.values())
