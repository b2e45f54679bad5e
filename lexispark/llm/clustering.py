"""Exact k-means (Lloyd's rounds on whole numbers) with triangle-inequality bounds and geometric drift tightening.

Every vector keeps an upper bound on the distance to its own centroid and a lower bound on the distance to all others.
When centroids move, the upper bound grows by its centroid's drift.  The usual lower bound falls by the greatest drift of
the others; here it falls by what geometry leaves of it.  The vectors of a cluster lie in a sphere about its centroid m, of
the greatest upper bound as radius r.  Let another centroid move from a to b.  How much nearer a point x can get,
|x - a| - |x - b|, is greatest in the plane through m, a and b, and is at most |b - a| cos(angle at the middle of a and b
between the move and x): with y for x's coordinate along the move from the middle, |x - a|**2 - |x - b|**2 = 2 y |b - a|, and
|x - a| + |x - b| is at least twice x's distance from the middle.  Seen from the middle the sphere spans asin(r / distance)
on either side of m, so the angle is at least m's less that; where it is over a right angle, no vector of the sphere got
nearer.  A vector whose upper bound is below its lower bound, or below half the distance from its centroid to the next
one, keeps its cluster; the rest are ambiguous: their own distance is taken, and if still needed all distances, exactly.

Layout.  Vectors are packed once into chunks (a matrix of the narrowest integers) and stored bucketed by chunk.  A round
reads them beside the bounds of the round before, which are bucketed alike, so the join moves nothing, and writes the
new bounds only.  Sums change by the vectors that moved, in whole numbers; of each round as many sums as clusters times
dimensions reach the driver.  A bucket holds chunks row by row, so no task holds more than a few chunks.

Defined results: vectors of another length, null, or with null, non-finite or too large entries (|scale * x| of 2**27 or
more: their squared distances leave long) are dropped; with fewer vectors than clusters there are as many clusters as
vectors; a null id takes part as the empty text where ids are hashed; equal hashes go by the vector; repeated ids and
vectors get a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.llm.storage import Workspace, small_batches
from lexispark.llm.whitening import of_width

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
TOO_LARGE = float(1 << 27)
EXACT_IN_DOUBLE = 1 << 22  # components below it: squared distances of up to 512 dimensions have 53 bits
CHUNK = 4096  # vectors
BUCKET_BYTES = 128 << 20  # of packed vectors
SLACK = 1e-9  # relative, for the rounding of bounds


def packed(x: np.ndarray) -> tuple[str, bytes]:
    reach = int(np.abs(x).max(initial=0))
    kind = "<i2" if reach < 1 << 15 else "<i4"
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT_IN_DOUBLE and x.shape[1] <= 512:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def closest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, distance to the next centroid); ties: the smaller number."""
    d = squared(x, centroids)
    own = d.argmin(axis=1)
    at = np.arange(len(x))
    best = d[at, own]
    others = d.astype(float)
    others[at, own] = np.inf
    return own, best, np.sqrt(others.min(axis=1))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: no vector of cluster i (in the sphere of `radius` about its old centroid) got nearer to centroid j by more."""
    old, new = old.astype(float), new.astype(float)
    move = new - old
    drift = np.sqrt((move**2).sum(axis=1))
    middle = (old + new) / 2
    out = np.zeros((len(old), len(old)))
    for i in range(len(old)):
        for j in range(len(old)):
            away = old[i] - middle[j]
            far = float(np.sqrt(away @ away))
            if drift[j] == 0 or not radius[i] >= 0:  # unmoved, or no vectors
                continue
            if far <= radius[i] * (1 + SLACK):
                out[i, j] = drift[j]
                continue
            angle = np.arccos(np.clip(away @ move[j] / (far * drift[j]), -1, 1)) - np.arcsin(radius[i] / far)
            out[i, j] = drift[j] * max(0.0, np.cos(max(0.0, angle)))
    np.fill_diagonal(out, 0.0)
    return out * (1 + SLACK) + SLACK


@dataclass(frozen=True)
class Move:
    """What a round needs to know: the centroids, and how far their move loosens the bounds."""

    centroids: np.ndarray
    drift: np.ndarray  # of each centroid
    loose: np.ndarray  # of each cluster's lower bounds
    half: np.ndarray  # half the distance from each centroid to the next one

    @classmethod
    def of(cls, old: np.ndarray | None, new: np.ndarray, radius: np.ndarray) -> Move:
        old = new if old is None else old
        apart = squared(new, new).astype(float)
        np.fill_diagonal(apart, np.inf)
        drift = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1)) * (1 + SLACK)
        return cls(new, drift, loosening(old, new, radius).max(axis=1), np.sqrt(apart.min(axis=1)) / 2)


def reassigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper bound, lower bound, vectors scanned) after a move."""
    own, upper, lower = own.copy(), upper + move.drift[own], np.maximum(lower - move.loose[own], 0)
    safe = lambda at: upper[at] * (1 + SLACK) + SLACK < np.maximum(lower[at], move.half[own[at]])
    at = np.flatnonzero(~safe(slice(None)))
    if len(at):  # tighten the upper bound
        upper[at] = np.sqrt(((x[at] - move.centroids[own[at]]) ** 2).sum(axis=1).astype(float))
        at = at[~safe(at)]
    if len(at):
        own[at], best, lower[at] = closest(x[at], move.centroids)
        upper[at] = np.sqrt(best.astype(float))
    return own, upper, lower, len(at)


def change(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums by cluster and dimension, counts by cluster) of what moved; -1 stands for no cluster."""
    moved = np.flatnonzero(before != after)
    sums, counts = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
    for c in range(k):
        into, out = moved[after[moved] == c], moved[before[moved] == c]
        sums[c] = x[into].sum(axis=0) - x[out].sum(axis=0)
        counts[c] = len(into) - len(out)
    return sums, counts


STATE = "chunk long, own binary, upper binary, lower binary, sums array<long>, counts array<long>, radius array<double>, scanned long"


def _state(chunk: int, x: np.ndarray, before: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, k: int) -> pa.RecordBatch:
    sums, counts = change(x, before, own, k)
    radius = [float(upper[own == c].max(initial=-1.0)) for c in range(k)]
    values = [chunk, own.astype("<i2").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(), sums.ravel().tolist(), counts.tolist(), radius, scanned]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["chunk", "own", "upper", "lower", "sums", "counts", "radius", "scanned"])


def _round(move: Move, width: int, first: bool):
    """Rows (chunk, kind, data[, own, upper, lower]) to STATE."""
    k = len(move.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                x = unpacked(row["kind"], row["data"], width)
                if first:
                    before = np.full(len(x), -1)
                    own, best, lower = closest(x, move.centroids)
                    upper, scanned = np.sqrt(best.astype(float)), len(x)
                else:
                    before = np.frombuffer(row["own"], "<i2").astype(np.int64)
                    own, upper, lower, scanned = reassigned(x, before, np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"), move)
                yield _state(row["chunk"], x, before, own, upper, lower, scanned, k)

    return run


def _final(centroids: np.ndarray, width: int):
    """Rows (ids, kind, data, own) to (vec_id, cluster, distance), a row for each vector: the exact squared distance to the
    own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kind, data, raw = (batch.column(c)[i].as_py() for c in range(1, 4))
                x, own = unpacked(kind, data, width), np.frombuffer(raw, "<i2").astype(np.int64)
                distance = ((x - centroids[own]) ** 2).sum(axis=1)
                yield pa.record_batch([batch.column(0)[i].values, pa.array(own, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _chunks(width: int, scale: int, id_type: pa.DataType):
    """Rows (vec_id, vector) to chunks of packed vectors.  Numbered by task; the table is written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held = TaskContext.get().partitionId() << 32, [], []

        def chunk() -> pa.RecordBatch:
            kind, data = packed(np.concatenate(held))
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(id_type)), pa.array([kind]), pa.array([data], pa.binary())], names=["chunk", "ids", "kind", "data"])

        for batch in batches:
            at, x = of_width(batch.column(1), width, scale=scale, offset=0, limit=TOO_LARGE)
            own = batch.column(0).take(pa.array(at))
            for lo in range(0, len(x), CHUNK):
                ids.append(own[lo : lo + CHUNK])
                held.append(x[lo : lo + CHUNK])
                if sum(map(len, held)) >= CHUNK:
                    yield chunk()
                    number, ids, held = number + 1, [], []
        if held:
            yield chunk()

    return run


class Buckets:
    """Tables of the shared folder, bucketed alike by chunk and known to the session's catalog while they are used."""

    def __init__(self, work: Workspace, buckets: int):
        self.work, self.buckets, self.prefix, self.known = work, buckets, f"clusters_{uuid.uuid4().hex[:12]}", set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{self.prefix}_{name}"
        df.write.format("parquet").option("path", f"{self.work.root}/{name}").bucketBy(self.buckets, "chunk").sortBy("chunk").saveAsTable(table)
        self.known.add(name)
        return self.work.spark.table(table)

    def forget(self, name: str) -> None:
        """Drop the catalog's entry; the files stay."""
        self.work.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
        self.known.discard(name)

    def drop(self, name: str) -> None:
        self.forget(name)
        self.work.drop(name)


def starts(df: DataFrame, k: int, seed: str, width: int, scale: int) -> np.ndarray:
    """The k usable vectors with the smallest sha256 of seed:id, in that order."""
    usable = F.forall("vector", lambda v: F.coalesce((v * scale < TOO_LARGE) & (v * scale >= 1 - TOO_LARGE), F.lit(False)))  # false for nan
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    whole = F.transform("vector", lambda v: F.floor(v * scale))
    rows = df.filter(F.col("vector").isNotNull() & (F.size("vector") == width) & usable).select(digest.alias("h"), whole.alias("x")).orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, width)


@dataclass
class Clustering:
    """`assigned`: vec_id, cluster, squared distance.  `history`: of each assignment, how many vectors were scanned."""

    assigned: DataFrame
    centroids: np.ndarray
    history: list[int]


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3", width: int = WIDTH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", work: Workspace | None = None) -> Clustering | None:
    """Lloyd's `rounds` and a last assignment over all usable vectors of `df`; None without any."""
    spark = df.sparkSession
    small_batches(spark)
    work = work or Workspace(spark, "clustering")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    centroids = starts(rows, k, seed, width, scale)
    if not len(centroids):
        return None
    kind = rows.schema["vec_id"].dataType
    count = rows.agg(F.count("*")).first()[0]
    tables = Buckets(work, max(1, min(50_000, -(-count * width * 2 // BUCKET_BYTES)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        chunks = tables.write(rows.mapInArrow(_chunks(width, scale, to_arrow_type(kind)), f"chunk long, ids array<{kind.simpleString()}>, kind string, data binary").repartition(tables.buckets, "chunk"), "chunks")
        vectors, state, history = chunks.select("chunk", "kind", "data"), None, []
        k = len(centroids)
        sums, counts = [[0] * width for _ in range(k)], [0] * k
        old, radius = None, np.full(k, -1.0)
        for t in range(rounds + 1):
            move = Move.of(old, centroids, radius)
            known = vectors if state is None else vectors.join(state.select("chunk", "own", "upper", "lower"), "chunk")
            state = tables.write(known.mapInArrow(_round(move, width, t == 0), STATE), f"state{t}")
            if t:
                tables.drop(f"state{t - 1}")
            history.append(state.agg(F.sum("scanned")).first()[0])
            if t == rounds:
                break
            added = {name: dict(state.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(total.alias("v")).collect())
                     for name, total in (("sums", F.sum(F.col("v").cast("decimal(38,0)"))), ("counts", F.sum("v")), ("radius", F.max("v")))}
            counts = [c + int(added["counts"][i]) for i, c in enumerate(counts)]
            sums = [[s + int(added["sums"][i * width + j]) for j, s in enumerate(own)] for i, own in enumerate(sums)]
            radius = np.array([added["radius"][i] for i in range(k)])
            old, centroids = centroids, np.array([[s // counts[i] for s in own] if counts[i] else centroids[i].tolist() for i, own in enumerate(sums)], np.int64)
        last = chunks.join(state.select("chunk", "own"), "chunk").select("ids", "kind", "data", "own")
        assigned = work.write(last.mapInArrow(_final(centroids, width), f"vec_id {kind.simpleString()}, cluster int, distance long"), "assigned")
        for name in ("chunks", f"state{rounds}"):
            tables.drop(name)
        return Clustering(assigned, centroids, history)
    finally:
        for name in list(tables.known):
            tables.forget(name)


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if found is None:
        return spark.createDataFrame([], schema)
    each = found.assigned.withColumn("vec_id", F.col("vec_id").cast("long"))
    sums = dict(each.groupBy("cluster").agg(F.sum("distance").alias("s")).collect())  # as many rows as clusters
    facts = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()) for c, own in enumerate(found.centroids.tolist())]
    return each.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*[c.split()[0] for c in schema.split(", ")])


def _sql() -> str:
    """The same rounds in SQL, each vector against each centroid."""
    steps = [f"""
    kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
    parts AS (SELECT r, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS i FROM kept),
    first AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept QUALIFY c < {CLUSTERS}),
    c0 AS (SELECT c, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS i FROM first)"""]  # fmt: skip
    for t in range(ROUNDS + 1):
        steps.append(f"""
    d{t} AS (SELECT p.r, m.c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM parts p JOIN c{t} m ON p.i = m.i GROUP BY p.r, m.c),
    a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if t < ROUNDS:
            steps.append(f"""
    s{t} AS (SELECT a.c, p.i, sum(p.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{t} a JOIN parts p ON a.r = p.r GROUP BY a.c, p.i),
    c{t + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{t} m LEFT JOIN s{t} s ON m.c = s.c AND m.i = s.i)""")
    return "WITH " + ",".join(steps) + f""",
    names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c),
    inertias AS (SELECT c, sum(d) AS d FROM a{ROUNDS} GROUP BY c)
    SELECT k.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, i.d::BIGINT AS cluster_inertia, (SELECT sum(d) FROM a{ROUNDS})::BIGINT AS inertia, n.centroid_sha256
    FROM kept k JOIN a{ROUNDS} a ON k.r = a.r JOIN names n ON a.c = n.c JOIN inertias i ON a.c = i.c"""


OP13_SQL = _sql()
