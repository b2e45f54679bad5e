"""op11 and op13: each against a plain version of its contract on edge cases; the parts against numpy."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from lexispark.llm import clustering as C
from lexispark.llm import registry
from lexispark.llm import whitening as M

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, n string, component string, chunk string"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors in clumps with nulls, non-finite entries, other lengths, copies, repeated and null ids, clashing columns."""
    path, r = str(tmp_path_factory.mktemp("vectors")), random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 6]]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(3, rows[9][1]), (3, rows[3][1]), (None, rows[10][1]), (None, rows[10][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [0.5] * 63), (2005, [float("nan")] + [0.5] * 63), (2006, [float("inf")] * 64), (2007, [-float("inf")] + [0.0] * 63)]
    all_rows = rows + bad
    r.shuffle(all_rows)
    spark.createDataFrame([(*x, 1, "x", "x", "x", "x", "x") for x in all_rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path, [(i, np.array(v, np.float32).astype(float)) for i, v in rows]


def test_op11_by_numpy(spark, vectors):
    got = registry.queries()["op11_embedding_whitening"](spark, vectors[0]).collect()
    x = np.array([np.floor(1024 * v) for _, v in vectors[1]]).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    own = centred @ basis / np.sqrt(values)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)
    for k in range(8):
        mine = [r for r in got if r["component"] == k + 1]
        key = lambda i, d, w: (-1 if i is None else i, d, round(w, 7))
        deviation = ((n * x - sums) ** 2).sum(axis=1)
        found = sorted(key(r["vec_id"], r["deviation"], r["whitened"]) for r in mine)
        either = [sorted(key(i, d, s * w) for (i, _), d, w in zip(vectors[1], deviation.tolist(), own[:, k])) for s in (1, -1)]
        assert found in either
        assert all(abs(r["explained"] - values[k] / np.trace(v)) < 1e-9 for r in mine)


def test_whitening_of_few_dimensions_and_of_none(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = M.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1}  # one direction varies
    for same in ([(1, [0.5, 0.5])], [(1, [2.0]), (2, [2.0])], [(1, None)]):
        assert M.whiten(spark.createDataFrame(same, "vec_id int, embedding array<double>")).count() == 0


@pytest.mark.parametrize("by", [100, 10_000])
def test_large_values_and_exact_deviations(spark, by):
    rows = [(i, [float(by * i), -float(by * i * i)]) for i in range(200)] + [(500, [1e300, 0.0])]
    got = M.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    x = [[1024 * by * i + 100_000, -1024 * by * i * i + 100_000] for i in range(200)]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((200 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: e if e < 1 << 63 else None for i, e in exact.items()}


@pytest.mark.parametrize("spectrum", [[5.0, 5, 5, 5, 3, 1, 1, 0, 0, 0], [1.0] * 12, [1e8, 1, 1e-3, 0], [2.0], [10, 10 - 1e-9, *np.linspace(9, 8.99999, 30)], [0.0] * 5, [3.0, -2, -7]])
def test_feast_misses_no_eigenvalue(spark, spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(len(spectrum)).standard_normal((len(spectrum),) * 2))
    v = q @ np.diag(spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = M.feast(spark, v, 8)
    scale = max(1, np.abs(v).max())
    assert np.allclose(values, sorted(spectrum, reverse=True)[:8], atol=1e-12 * scale)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * scale and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_counts():
    a = np.random.default_rng(1).standard_normal((30, 30))
    v = a + a.T
    spectrum, values = M.Spectrum(v), np.linalg.eigvalsh(v)
    for shift in [*np.linspace(-20, 20, 101), *(values + 1e-9), *(values - 1e-9)]:
        assert spectrum.above(shift) == (values > shift).sum()


def lloyd(rows):
    x = np.array([np.floor(1024 * v) for _, v in rows]).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda k: (hashlib.sha256(f"3:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), x[k].tolist()))
    centroids = x[order[:8]].copy()
    for _ in range(10):
        own = ((x[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(8):
            if (own == c).any():
                centroids[c] = x[own == c].sum(axis=0) // (own == c).sum()
    d = ((x[:, None] - centroids) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1), centroids


def test_op13_by_plain_rounds(spark, vectors):
    got = registry.queries()["op13_centroid_clustering"](spark, vectors[0]).collect()
    own, d, centroids = lloyd(vectors[1])
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    plain = [(i, c, e, int(d[own == c].sum()), int(d.sum()), sha[c]) for (i, _), c, e in zip(vectors[1], own.tolist(), d.tolist())]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, plain))


def test_op13_sql(spark, vectors):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{vectors[0]}/embeddings.parquet/*.parquet'")
    got = registry.queries()["op13_centroid_clustering"](spark, vectors[0]).collect()
    assert sorted(map(lambda r: str(tuple(r)), got)) == sorted(map(str, con.execute(C.OP13_SQL).fetchall()))


def test_bounds_spare_scans_and_joins_move_nothing(spark, vectors):
    df = spark.read.parquet(f"{vectors[0]}/embeddings.parquet")
    found = C.cluster(df)
    assert found.history[0] == len(vectors[1]) and sum(found.history[-3:]) < 0.5 * 3 * len(vectors[1])
    work = C.Workspace(spark, "plan")
    tables = C.Buckets(work, 3)
    a, b = (tables.write(spark.range(50).selectExpr("id AS chunk", f"id AS {n}").repartition(3, "chunk"), n) for n in "ab")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in a.join(b, "chunk")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        tables.drop("a")
        tables.drop("b")


def test_fewer_vectors_than_clusters(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    found = C.cluster(spark.createDataFrame(rows, "vec_id int, embedding array<float>"))
    assert len(found.centroids) == 3 and sorted(r["distance"] for r in found.assigned.collect()) == [0, 0, 0]


def test_loosening_bounds_every_vector_of_the_sphere():
    """No point of a cluster's sphere gets nearer to a moved centroid than the bound says, which is below the full drift
    where the move does not point away from the sphere."""
    rng = np.random.default_rng(2)
    tighter = 0
    for _ in range(200):
        old = rng.normal(0, 100, (4, 5))
        new = old + rng.normal(0, 30, (4, 5))
        radius = rng.uniform(0, 150, 4)
        bound = C.loosening(old, new, radius)
        for i in range(4):
            u = rng.normal(size=(300, 5))
            x = old[i] + u / np.linalg.norm(u, axis=1)[:, None] * radius[i]
            for j in range(4):
                if i != j:
                    nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                    assert nearer.max() <= bound[i, j] + 1e-9
                    tighter += bound[i, j] < 0.9 * np.linalg.norm(new[j] - old[j])
    assert tighter > 500


def test_reassigned_equals_a_full_scan():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 6))
    old = rng.integers(-300, 300, (5, 6))
    own, best, lower = C.closest(x, old)
    upper = np.sqrt(best.astype(float))
    for _ in range(20):
        new = old + rng.integers(-20, 20, old.shape)
        move = C.Move.of(old, new, np.array([upper[own == c].max(initial=-1.0) for c in range(5)]))
        own, upper, lower, scanned = C.reassigned(x, own, upper, lower, move)
        assert (own == C.closest(x, new)[0]).all() and scanned <= len(x)
        old = new
