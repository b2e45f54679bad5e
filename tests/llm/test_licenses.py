"""op12 against brute force on edge cases; the filters against all pairs."""

import random
import re
from collections import Counter

import duckdb

from lexispark.llm import licenses as L
from lexispark.llm import registry


def found_by_force(text, templates, percent):
    """{(label, overlap)} of all windows of all blocks."""
    out = set()
    lines = [L.split(line) for line in (text or "").split("\n")]
    paragraphs, run = [], []
    for words in [*lines, []]:
        if words:
            run += words
        elif run:
            paragraphs.append(run)
            run = []
    for label, template in templates:
        words = L.split(template)
        if not words:
            continue
        gap, step = L.step_of(len(words))
        for block in paragraphs if gap else lines:
            for k in range(0, max(1, len(block)), step):
                both = len(set(words) & set(block[k : k + 2 * step]))
                if 100 * both >= percent * len(set(words)):
                    out.add((label, both))
    return out


def documents(seed=1):
    r = random.Random(seed)
    noise = lambda n: [r.choice(["foo", "bar", "the", "of", "license", "version", "to", "software", "in"]) for _ in range(n)]
    out = [(0, None), (1, ""), (2, " \n\n"), (3, "Released under the MIT License."), (4, "released under\nthe mit LICENSE"), (5, "CC BY cc by-nc"), (None, "Apache License, Version 2.0"), (None, None), (3, "Apache"), (6, "nothing " * 30_000 + "Released under the MIT License." + " more" * 100)]
    for k, (label, text) in enumerate(L.TEMPLATES * 4):
        words = text.split(" ")
        for _ in range(r.randrange(4)):  # some words replaced
            words[r.randrange(len(words))] = "other"
        if r.random() < 0.5:  # wrapped
            words = [w + ("\n" if r.random() < 0.1 else "") for w in words]
        if r.random() < 0.3:
            r.shuffle(words)
        out.append((100 + k, " ".join(noise(r.randrange(700)) + ([] if r.random() < 0.5 else ["\n\n"]) + words + noise(r.randrange(700)))))
    return out


def test_op12_by_brute_force(spark, tmp_path):
    docs = documents()
    spark.createDataFrame([(*d, "x", "x") for d in docs], "doc_id long, text string, labels string, n_words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for doc_id, text in docs:
        words, places = L.split(text), []
        for phrase, label in L.PHRASES:
            p = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        blocks = found_by_force(text, L.TEMPLATES, L.PERCENT)
        sizes = {label: len(set(L.split(t))) for label, t in L.TEMPLATES}
        score = 1.0 if places else max((both / sizes[label] for label, both in blocks), default=0.0)
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(label for label, _ in blocks)})
        expected[(doc_id, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(base), ",".join(labels), round(score, 9))] += 1
    got = registry.queries()["op12_license_scan"](spark, str(tmp_path)).collect()
    assert Counter((*tuple(r)[:7], round(r["score"], 9)) for r in got) == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter((*r[:7], round(r[7], 9)) for r in con.execute(L.OP12_SQL).fetchall()) == expected


def test_filters_lose_no_block_and_parts_change_nothing(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    templates = [(f"t{k}", " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 9, 14, 40, 60])))) for k in range(40)] + [("none", " .,"), ("t0", "w1"), ("t0", "w1")]
    docs = [(k, "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 10, 80, 300]))) for _ in range(r.randrange(6)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (50, 85, 100):
        got = L.license_scan(df, templates, percent=percent).collect()
        assert {x["doc_id"]: {(b["label"], b["overlap"]) for b in x["blocks"]} for x in got} == {k: found_by_force(t, templates, percent) for k, t in docs}
    whole, parted = (L.license_scan(df, templates, part_bytes=n).collect() for n in (1 << 20, 200))
    canon = lambda rows: sorted((x["doc_id"], x["n_words"], sorted(map(tuple, x["blocks"])), x["places"]) for x in rows)
    assert canon(whole) == canon(parted)


def test_spans_hold_the_template(spark):
    text = "one two three\nfour This work is licensed under the GNU General Public License, version 3. five"
    row = L.license_scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    block = next(b for b in row["blocks"] if b["label"] == "gpl-statement")
    assert L.split(text)[block["first"] : block["last"] + 1] == L.split("This work is licensed under the GNU General Public License, version 3.")
    assert row["places"][0]["at"] == L.split(text).index("gnu") and row["places"][0]["label"] == "gpl"


def test_word_pattern_is_the_contract(spark):
    text = "".join(chr(c) for c in range(1, 0x250)) + " Ünïcode_under-score"
    row = L.license_scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row["n_words"] == len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(L.LOWER)))
