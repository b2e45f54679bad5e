"""Substring dedup where classes meet an unlike class, and where a word inside a paragraph differs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import substrings
from lexispark.llm import words as W
from lexispark.llm.components import components
from lexispark.llm.storage import Workspace


def closed(edges):
    """Node -> smallest node it reaches."""
    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, a), group.setdefault(b, b)
        if x != y:
            for n in [n for n, g in group.items() if g == max(x, y)]:
                group[n] = min(x, y)
    return group


@pytest.mark.parametrize("chunk", [512, 3])
def test_all_members_of_a_run_are_compared(spark, chunk):
    """Similar classes are linked although the run's smallest class is like neither."""
    r = random.Random(4)
    base = [[f"w{r.randrange(10**6)}" for _ in range(r.randrange(8, 14))] for _ in range(60)]
    texts = []
    for line in base:
        for _ in range(8):
            own = list(line)
            own[r.choice([0, len(own) - 1])] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    docs, bands, percent = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 60
    g = substrings.Segments(next(W.slices(pa.array(texts, pa.string()))))
    names = g.line_fp.view(np.int64).tolist()
    sets = {f: set(g.element[a:b].tolist()) for f, a, b in zip(names, g.edge[:-1], g.edge[1:])}
    runs = defaultdict(set)
    for key, f in zip(g.band_keys(bands)[0].tolist(), names):
        runs[key].add(f)
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    whole = closed((a, b) for run in runs.values() for a in run for b in run if a != b and like(a, b))
    starred = closed((a, b) for run in runs.values() for b in [min(run, key=lambda x: x % 2**64)] for a in run if a != b and like(a, b))
    work = Workspace(spark, "t")
    pieces = work.write(docs.mapInArrow(substrings._cut(bands, percent, 4), substrings.CUT_SCHEMA), "pieces")
    edges = substrings.links(docs, pieces, percent, 4, work, chunk)
    found = {x["node"]: x["component"] for x in components(edges.toDF("u", "v"), work).collect()}
    assert found == whole and found != starred


def test_lines_with_a_changed_word_are_whole(spark):
    """A paragraph of 50 words with one inner word changed is one passage in both documents."""
    r = random.Random(21)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    rows, spans = [], {}
    for i in range(0, 60, 2):
        line = fresh(50)
        near = list(line)
        near[20 + i % 10] = "changed"
        for k, own in ((i, line), (i + 1, near)):
            head, tail = fresh(r.randrange(20, 40)), fresh(30)
            rows.append((k, "\n".join(" ".join(x) for x in (head, own, tail))))
            spans[k] = (len(head), len(head) + 50, 50, i - i % 2, k % 2 == 1)
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = defaultdict(list)
    for x in found:
        got[x["doc_id"]].append((x["first_word"], x["end_word"], x["n_words"], x["first_doc_id"], x["removed"]))
    whole = sum(got[k] == [spans[k]] for k in spans)
    assert whole >= 0.9 * len(spans) and not any(len(v) > 1 for v in got.values())


def test_passages_inside_lines_are_joined_across_a_changed_word(spark):
    r = random.Random(22)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    rows = []
    for i in range(0, 60, 2):
        part = fresh(50)
        near = list(part)
        near[25] = "changed"
        rows += [(i, " ".join(fresh(40) + part + fresh(40))), (i + 1, " ".join(fresh(40) + near + fresh(40)))]
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = [x for x in found if x["doc_id"] % 2]
    assert len(copies) == 30 and all(x["first_doc_id"] == x["doc_id"] - 1 for x in copies)  # and one passage each
    # with fewer than two common cuts between the change and an edge, that side has no segment to match
    across = [x for x in copies if x["first_word"] <= 65 - 8 and x["end_word"] >= 65 + 8]
    assert len(across) >= 27 and all(1 <= x["n_bridged"] <= substrings.GAP for x in across)
    assert all(x["n_bridged"] == 0 for x in copies if not x["first_word"] <= 65 < x["end_word"])


def test_null_ids(spark):
    r = random.Random(5)
    a, b = (" ".join(f"w{r.randrange(10**7)}" for _ in range(40)) for _ in range(2))
    rows = [(None, a), (3, a), (4, a), (None, b), (None, b)]
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x["n_bridged"] == 0 for x in found)
    got = sorted((x["doc_id"] or 0, x["n_words"], x["first_doc_id"] or 0, x["removed"]) for x in found)
    assert got == [(0, 40, 0, False), (0, 40, 0, True), (0, 40, 3, True), (3, 40, 3, False), (4, 40, 3, True)]


def collection(r):
    """Documents with common lines, shared passages, near copies of paragraphs, null ids and repeated rows."""
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    notice = " ".join(fresh(20))
    shared = [fresh(60) for _ in range(15)]
    rows = []
    for i in range(200):
        lines = [" ".join(fresh(r.randrange(3, 60))) for _ in range(r.randrange(1, 4))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), notice)
        if i % 2:
            part = list(r.choice(shared))
            if i % 4 == 1:
                part[r.randrange(60)] = "changed"
            lines.insert(0, " ".join(part if i % 5 else fresh(20) + part + fresh(20)))
        rows.append((None if i % 41 == 0 else i, "\n".join(lines)))
    return rows + rows[10:14] + [(900, None), (901, ""), (902, " \n\t")]


def test_results_do_not_depend_on_partitions(spark):
    rows = collection(random.Random(31))
    results = []
    for parts in (1, 4, 64):
        docs = spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id IS NOT NULL").repartition(parts)
        results.append(sorted((tuple(x) for x in substrings.repeated_passages(docs).collect()), key=str))
    assert results[0] and results[0] == results[1] == results[2]


def test_links_against_brute_force(spark):
    """Of all pairs of unlike paragraphs at the threshold, nearly all end in one cluster, and no others do."""
    r = random.Random(33)
    texts = []
    for _ in range(150):
        line = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(20, 80))]
        for _ in range(4):
            own = list(line)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    docs, percent = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80
    g = substrings.Segments(next(W.slices(pa.array(texts, pa.string()))))
    sets = {f: set(g.element[a:b].tolist()) for f, a, b in zip(g.line_fp.view(np.int64).tolist(), g.edge[:-1], g.edge[1:])}
    like = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    work = Workspace(spark, "t")
    bands = substrings.tune(percent, substrings.RECALL)
    pieces = work.write(docs.mapInArrow(substrings._cut(bands, percent, 8), substrings.CUT_SCHEMA), "pieces")
    edges = substrings.links(docs, pieces, percent, 8, work)
    found = {x["node"]: x["component"] for x in components(edges.toDF("u", "v"), work).collect()}
    caught = sum(a in found and found[a] == found.get(b) for a, b in like)
    assert len(like) > 100 and caught >= 0.95 * len(like)
    whole = closed(like)
    assert all(whole[n] == whole[c] for n, c in found.items())


def test_a_line_in_every_document(spark):
    """Very many equal lines before repeated passages: nothing overflows, nothing is lost."""
    r = random.Random(35)
    passage = lambda: " ".join(f"w{r.randrange(10**7)}" for _ in range(30))
    repeated = [passage() for _ in range(100)]
    rows = [(0, "common line here\n" * 80_000)] + [(1 + k, p) for k, p in enumerate(repeated)] + [(501 + k, "common line here\n" + p) for k, p in enumerate(repeated)]
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    long = {x["doc_id"]: x["n_words"] for x in found if x["doc_id"] > 0}
    assert long == {1 + k: 30 for k in range(100)} | {501 + k: 33 for k in range(100)}


def test_cuts_do_not_depend_on_neighbours():
    r = random.Random(37)
    texts = ["\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 40))) for _ in range(3)) for _ in range(50)]
    together = substrings.Segments(next(W.slices(pa.array(texts, pa.string()))))
    for k, t in enumerate(texts):
        alone = substrings.Segments(next(W.slices(pa.array([t], pa.string()))))
        assert alone.fp.tolist() == together.fp[together.doc == k].tolist()
        assert alone.line_fp.tolist() == together.line_fp[together.line_doc == k].tolist()


def test_empty(spark):
    assert substrings.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
