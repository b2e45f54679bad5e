"""Links across chunks and runs, each counted once, against brute force."""

import random

from lexispark.llm import parity_join


def brute(texts, size, percent):
    sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for i, w in enumerate(t.split() for t in texts)}
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
    return links


def test_links_across_small_chunks_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "CHUNK_DOCS", 4)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    shared = [word() for _ in range(40)]
    for group in range(12):
        base = [word() for _ in range(rng.choice((30, 80, 200)))]
        if group % 2:
            base[5:5] = shared[: rng.choice((20, 40))]
        for _ in range(rng.choice((1, 2, 9, 25))):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for size, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: r["n_links"] for r in parity_join.ngram_jaccard_groups(docs, size, percent).collect()}
        assert got == brute(texts, size, percent)


def test_null_and_repeated_ids_link_like_others(spark):
    """Chains through rows without an id, rows of one id with unlike texts; against all pairs of rows."""
    r = random.Random(8)
    rows, base = [], [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(12)]
    for k, words in enumerate(base):
        for step in range(5):  # a chain: each is near the one before, the ends are not near each other
            words = [*words]
            for _ in range(2):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            rows.append((r.choice([None, 100 * k + step, 7]), " ".join(words)))
    rows += [(None, rows[3][1]), (rows[4][0], rows[4][1]), (None, ""), (5, None), (7, "short"), (None, "short")]
    r.shuffle(rows)
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (text or "").split()) else set() for _, text in rows]
    near = [[100 * len(a & b) >= 85 * len(a | b) if a and b else False for b in sets] for a in sets]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    expected = []
    for i, (doc_id, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] and sets[j] == sets[i]] or [doc_id]
        expected.append((doc_id, len(sets[i]), least(own), least(same), sum(near[i]) - near[i][i]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(x[c] for c in ("doc_id", "n_shingles", "component_id", "class_id", "n_links")) for x in parity_join.ngram_jaccard_groups(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def chained_groups(seed):
    """Groups of near copies, some of them chains whose ends are far apart, with passages that groups share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts, shared = [], [word() for _ in range(40)]
    for group in range(10):
        base = [word() for _ in range(r.choice((30, 80, 200)))]
        base[5:5] = shared[: r.choice((0, 20, 40))]
        for _ in range(r.choice((2, 9, 30))):
            own = list(base)
            for _ in range(r.randrange(9)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
            base = own if group % 3 == 0 and r.random() < 0.3 else base
    return texts


def test_components_alone_are_those_of_all_links(spark, monkeypatch):
    """Without links, hubs and runs of one component are left out: components and classes stay, and fewer pairs of chunks meet."""
    monkeypatch.setattr(parity_join, "CHUNK_DOCS", 4)
    monkeypatch.setattr(parity_join, "HUBS", 2)
    docs = spark.createDataFrame(list(enumerate(chained_groups(11))), "doc_id long, text string").repartition(5)
    made, write = {}, parity_join.Workspace.write

    def counted(self, df, table):
        out = write(self, df, table)
        made[table] = out.count()
        return out

    monkeypatch.setattr(parity_join.Workspace, "write", counted)
    rows = lambda df: sorted(tuple(x) for x in df.select("doc_id", "n_shingles", "component_id", "class_id").collect())
    expected = rows(parity_join.ngram_jaccard_groups(docs, 5, 80))
    met = made["met"]
    found = parity_join.ngram_jaccard_groups(docs, 5, 80, links=False)
    assert "n_links" not in found.columns and rows(found) == expected
    assert len({x[2] for x in expected}) < len(expected) and made["met"] < met


def test_comparisons_are_shipped_in_waves(spark, monkeypatch):
    """What comparisons ship is dealt to waves by its bytes, each written and freed before the next one; the links stay."""
    monkeypatch.setattr(parity_join, "CHUNK_DOCS", 4)
    monkeypatch.setattr(parity_join, "RUN_DOCS", 2)
    docs = spark.createDataFrame(list(enumerate(chained_groups(11))), "doc_id long, text string").repartition(5)
    rows = lambda links: sorted(tuple(x) for x in parity_join.ngram_jaccard_groups(docs, 5, 80, links=links).drop("n_links" if not links else "").collect())
    expected = rows(True), rows(False)
    tables, write = [], parity_join.Workspace.write
    monkeypatch.setattr(parity_join.Workspace, "write", lambda self, df, table: tables.append(table) or write(self, df, table))
    monkeypatch.setattr(parity_join, "WAVE_BYTES", 2000, raising=False)
    assert (rows(True), rows(False)) == expected
    assert tables.count("of_chunks1") == tables.count("of_runs1") == 2
