"""The registered op queries on a small directory with nulls, empties, long and repeated rows and clashing columns,
each against a plain version of its contract; and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexispark.llm import registry

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "score double, size long, text_crc32 string, shard string, n_words string, component_id string, mask string, digest string, row string, block string, chunk string, fp string, bucket string, bins string, stratum string, held_out string"
EMPTY_DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def held(doc_id, modulus):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % modulus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """200 documents of the smallest table, with edge cases beside them."""
    path, r = str(tmp_path_factory.mktemp("ops")), random.Random(4)
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(200).collect()]
    passage = " ".join(f"passage{r.randrange(10**6)}" for _ in range(60))
    extra = [
        (5000, None, "en", "src0", None), (5001, "", None, None, 0), (5002, " \n\t ", "en", None, 3), (5003, "123 456", "de", "src0", 7),
        (5004, docs[3][1], docs[3][2], "src1", 5), (docs[5][0], docs[5][1], docs[5][2], docs[5][3], 5), (None, docs[7][1], docs[7][2], "src1", 5), (None, "kurz", "de", "src1", 4),
        (5005, "wort " * 30_000, "de", "src2", 150_000), (5006, docs[9][1] + " " + passage, docs[9][2], "src2", 9), (5007, passage + "\n" + docs[11][1], docs[11][2], "src2", 9),
        (docs[13][0], "another text under an id that another row has too", "en", "src0", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs + extra, schema).repartition(3)
    names = [c.split() for c in CLASH.split(", ")]
    frame.selectExpr("*", *[f"CAST(7 AS {kind}) AS {name}" for name, kind in names]).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").selectExpr("*", "'x' AS text_crc32", "1.5 AS score").write.parquet(f"{path}/{name}.parquet")
    return path, docs + extra


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], EMPTY_DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def result(spark, folder, name):
    return registry.queries()[name](spark, folder[0]).collect()


def texts_by_id(rows):
    out = defaultdict(list)
    for doc_id, text, *_ in rows:
        out[doc_id].append(text)
    return out


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_on_empty_tables(spark, nothing, name):
    assert registry.queries()[name](spark, nothing).count() == 0


def test_pipeline_on_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_op1(spark, folder):
    got = result(spark, folder, "op1_ngram_jaccard_join")
    rows = folder[1]
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 20 * min(len(sets[a]), len(sets[b])) >= 17 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
    least = {}
    for g, (doc_id, *_) in zip(group, rows):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    expected = Counter((doc_id, len(s), least.get(g)) for (doc_id, *_), s, g in zip(rows, sets, group))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected


def test_op2(spark, folder):
    got = result(spark, folder, "op2_lm_scoring")
    rows = folder[1]
    counts = Counter()
    for doc_id, text, *_ in rows:
        if held(doc_id, 10):
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for doc_id, text, *_ in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        expected[(doc_id, held(doc_id, 10) == 0, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    own = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert all(r["score"] <= 0 for r in got) and sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_op3(spark, folder):
    got = result(spark, folder, "op3_language_id")
    rows = folder[1]
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (held(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert {pred[i] for i in (5000, 5001, 5002, 5003)} == {"und"}
    known = [(r["lang_pred"], lang) for r in got if r["held_out"] for i, text, lang, *_ in rows if i == r["doc_id"] and i is not None and i < 5000 and lang and len(words(text)) > 5]
    assert sum(a == b for a, b in known) >= 0.95 * len(known) > 20


def test_op4(spark, folder):
    got = result(spark, folder, "op4_substring_dedup")
    texts = texts_by_id(folder[1])
    for r in got:
        assert r["n_words"] == r["end_word"] - r["first_word"] >= 16 and any(r["end_word"] <= len(words(t)) for t in texts[r["doc_id"]])
    own = [r for r in got if r["doc_id"] == 5007]  # a passage of 5006, then all of another document
    assert own[0]["removed"] and min(r["first_word"] for r in own) <= 10 and sum(r["n_words"] for r in own) >= 0.9 * len(words(folder[1][-2][1]))
    tail = [r for r in got if r["doc_id"] == 5006]
    assert max(r["end_word"] for r in tail) >= len(words(folder[1][-3][1])) - 1
    # a whole copy is one passage over nearly all of its words
    copy = [r for r in got if r["doc_id"] == 5004]
    assert sum(r["n_words"] for r in copy) >= 0.9 * len(words(folder[1][3][1])) and all(r["removed"] for r in copy)


def test_op5(spark, folder):
    got = result(spark, folder, "op5_mix_sources")
    rows = folder[1]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in got)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    assert {r["source_size"] for r in got} == set(sizes.values())
    source_of = {i: source for i, _, _, source, _ in rows if i is not None and i not in (rows[5][0], rows[13][0])}
    targets, taken = {}, Counter()
    for r in got:
        if r["doc_id"] in source_of:
            targets[source_of[r["doc_id"]]] = r["target"]
    assert math.isclose(sum(targets.values()), sum(sizes.values()), rel_tol=1e-6)
    for r in got:
        taken[r["target"], r["source_size"]] += r["taken"]
    again = result(spark, folder, "op5_mix_sources")
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_op6(spark, folder):
    got = result(spark, folder, "op6_quality_rules")
    expected = Counter()
    for doc_id, text, *_ in folder[1]:
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = len({k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)})
        expected[(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeat, len(w) < 10 or 100 * repeat > 20 * len(w))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"], r["base_failed"]) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op7(spark, folder):
    got = result(spark, folder, "op7_toxicity")
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in folder[1])
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    again = result(spark, folder, "op7_toxicity")
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_op8(spark, folder):
    got = result(spark, folder, "op8_balanced_shards")
    rows = folder[1]
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, *sized(t)) for i, t, *_ in rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    biggest = max(sized(t)[0] for _, t, *_ in rows)
    assert max(load.values()) - sum(load.values()) / 16 <= biggest


def test_op9(spark, folder):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", lambda t: [m.span() for m in assign.finditer(t) if len(m.group(2)) >= 8]), ("access", lambda t: [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]),
             ("hex", lambda t: [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32])]
    expected = Counter()
    for doc_id, text, *_ in folder[1]:
        found = [(a, k, b, name) for k, (name, find) in enumerate(kinds) for a, b in find(text or "")]
        base = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
        n = Counter(name for *_, name in found)
        expected[(doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest())] += 1
    got = result(spark, folder, "op9_secret_scan")
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == expected
    for r in got:
        own = [s for s in r["spans"].split(",") if s and not s.startswith("cnn")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r["base_sha256"]


def test_op10(spark, folder):
    item_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: item_word.findall((t or "").translate(LOW))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect():
        w = split(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    sizes = {len(k) for k in windows}
    expected = Counter()
    for doc_id, text, *_ in folder[1]:
        w, hit, items = split(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= own
        expected[(doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    got = result(spark, folder, "op10_benchmark_decontamination")
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == expected
    assert all(r["n_near_items"] >= r["n_items"] for r in got)
