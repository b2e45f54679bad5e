"""Language-model scoring by deleted interpolation.

    P_m(w | context) = a_m(b) * c(context w)/c(context) + (1 - a_m(b)) * P_(m-1)(w | shorter context)
    P_0 = 1/(V+1)

with maximum-likelihood estimates of order m from the training documents, and b the frequency class
(power of two) of the context.  Each weight a_m(b) is learned by expectation-maximisation on a held-out part
of the training documents, with that part's own counts deleted from the estimates.  A mixture of two fixed
distributions depends only on their ratio, so EM needs one histogram of log-ratios per order and class: of
fixed size, gathered over every held-out token.

Counting: documents are read in chunks; a chunk sends its distinct n-gram hashes with counts, packed per
bucket of hashes, and a bucket answers each chunk with the corpus counts of just those n-grams.  Counts and
answers grow with the corpus and stay distributed; the driver sees the histograms and two totals.

A chunk is named by a digest of its ids and texts, so both reads must cut the same chunks; that holds for a
table read from files.  Other inputs are written to the shared folder first (`stored=False`).  A chunk without
its answers stops the job rather than scoring wrongly.  Chunks with the same ids and texts (a table that holds a
file twice) count twice and share their answers.

Defined results: null and empty text is one token, the end; repeated rows count as often as they occur;
without training rows all counts are 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.storage import Workspace, bucket_count, training_row

_U = np.uint64
ORDER = 2
MODULUS, HELD_OUT, EM_PART = 10, 0, 1
CHUNK_BYTES = 4 << 20
CLASSES = 24
BINS, BINS_PER_OCTAVE, LOWEST = 3200, 32, -50
EM_STEPS = 200
_END, _START = W.mix(np.array([101, 202], _U))
_CODEC = "zstd"


def planes64(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes64(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed(values: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds the largest, plane by plane after a byte that tells the width."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return out.view("<i8").ravel()


class Chunk:
    """Consecutive documents of one role, as token sequences with an end after each document."""

    def __init__(self, ids: list, column: pa.Array):
        self.ids = ids
        hashes, per_doc = [], []
        for s in W.slices(column):
            w = W.words(s)
            hashes.append(w.hash)
            per_doc.append(w.per_doc)
        self.n_tokens = np.concatenate(per_doc) + 1
        self.last = np.cumsum(self.n_tokens) - 1
        self.first = self.last - self.n_tokens + 1
        token = np.empty(int(self.n_tokens.sum()), _U)
        inner = np.ones(len(token), bool)
        inner[self.last] = False
        token[inner] = np.concatenate(hashes)
        token[self.last] = _END
        self.token = token

    def grams(self, order: int) -> list[np.ndarray]:
        """For m = 1..order, the hash of the m tokens that end at each position.  Bit 0 marks m = 1."""
        out = [self.token | _U(1)]
        for m in range(2, order + 1):
            before = np.empty_like(self.token)
            before[1:] = out[-1][:-1]
            before[self.first] = _START
            out.append(W.mix(before * _U(0x9FB21C651E98DF25) + W.mix(self.token + _U(m))) & ~_U(1))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, pa.Array]]:
    """(role, chunk name, document ids, texts); columns: doc_id, text, role.  A role's rows fill a chunk across
    batches, up to CHUNK_BYTES of text."""
    ids: dict[int, list] = {}
    texts: dict[int, list[pa.Array]] = {}
    held: dict[int, int] = {}

    def flush(role: int) -> tuple[int, int, list, pa.Array]:
        own, column = ids.pop(role), pa.concat_arrays(texts.pop(role))
        held.pop(role)
        data, offsets = W.utf8(column)
        digest = hashlib.blake2b(data.tobytes(), digest_size=8, key=f"{role}".encode())
        digest.update(offsets.tobytes())
        digest.update(repr(own).encode())
        return role, int.from_bytes(digest.digest(), "little", signed=True), own, column

    for batch in batches:
        roles = batch.column(2).to_numpy(zero_copy_only=False)
        for role in np.unique(roles).tolist():
            rows = batch.filter(pa.array(roles == role))
            column = rows.column(1).cast(pa.large_string()).fill_null("")
            for s in W.slices(column, CHUNK_BYTES, 1 << 16):
                if held.get(role, 0) + len(s.data) > CHUNK_BYTES and role in ids:
                    yield flush(role)
                ids.setdefault(role, []).extend(rows.column(0).slice(s.lo, s.hi - s.lo).to_pylist())
                texts.setdefault(role, []).append(column.slice(s.lo, s.hi - s.lo))
                held[role] = held.get(role, 0) + len(s.data)
    for role in sorted(ids):
        yield flush(role)


def _ask(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for role, name, ids, texts in _chunks(batches):
            gram, count = np.unique(np.concatenate(Chunk(ids, texts).grams(order)), return_counts=True)
            bucket = ((gram >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            keys = [planes64(np.diff(gram[edge[b] : edge[b + 1]], prepend=_U(0))) for b in used]
            counts = [b"" if role == HELD_OUT else packed(count[edge[b] : edge[b + 1]]) for b in used]
            n = len(used)
            yield pa.record_batch([pa.array([name] * n, pa.int64()), pa.array([role] * n, pa.int32()), pa.array(used, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "role", "bucket", "keys", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one bucket: the corpus count of every n-gram asked for, and in the EM part that part's count too."""
    asked, keys, counts, parts = [], [], [], []
    for batch in batches:
        for row in W.rows(batch):
            role = row["role"]
            key = np.cumsum(unplanes64(row["keys"]), dtype=_U)
            own = unpacked(row["counts"]) if row["counts"] else np.zeros(len(key), np.int64)
            asked.append((row["chunk"], row["bucket"], role))
            keys.append(key)
            counts.append(own)
            parts.append(own if role == EM_PART else np.zeros(len(key), np.int64))
    if not asked:
        return
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    everything = np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
    part = np.bincount(inverse, np.concatenate(parts), len(key)).astype(np.int64)
    single = (key & _U(1)) == 1
    totals = [int((single & (everything > 0)).sum()), int(everything[single].sum()), int(part[single].sum())]
    yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([totals], pa.list_(pa.int64()))], names=["chunk", "bucket", "counts", "part", "totals"])
    at, answered = 0, set()
    for (chunk, bucket, role), k in zip(asked, keys, strict=True):
        own = inverse[at : at + len(k)]
        at += len(k)
        if chunk in answered:  # equal chunks have one answer
            continue
        answered.add(chunk)
        yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed(everything[own])], pa.binary()), pa.array([packed(part[own]) if role == EM_PART else b""], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["chunk", "bucket", "counts", "part", "totals"])


def _carry(roles: tuple[int, ...]):
    """One row per chunk of the given roles: its ids and its texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(_CODEC, compression_level=1)
        for role, name, ids, texts in _chunks(batches):
            if role in roles:
                data, offsets = W.utf8(texts)
                yield pa.record_batch([
                    pa.array([name], pa.int64()), pa.array([role], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())),
                    pa.array([codec.compress(data.tobytes(), asbytes=True)], pa.binary()),
                ], names=["chunk", "role", "ids", "offsets", "data"])

    return run


def _opened(row: dict) -> tuple[Chunk, np.ndarray | None, np.ndarray | None]:
    """The chunk of a joined row, with the answers in the order of its sorted distinct n-grams."""
    if row["answers"] is None:
        raise RuntimeError("a chunk was cut differently in the second read; pass stored=False for this input")
    data = pa.Codec(_CODEC).decompress(row["data"], row["offsets"][-1], asbytes=True) if row["offsets"][-1] else b""
    texts = pa.LargeStringArray.from_buffers(len(row["ids"]), pa.py_buffer(np.array(row["offsets"], np.int64)), pa.py_buffer(data))
    answers = sorted(row["answers"], key=lambda a: a["bucket"])
    part = [unpacked(a["part"]) for a in answers if a["part"]]
    return Chunk(row["ids"], texts), np.concatenate([unpacked(a["counts"]) for a in answers]), np.concatenate(part) if part else None


def _aligned(chunk: Chunk, order: int, counts: np.ndarray) -> list[np.ndarray]:
    """Corpus counts of the n-grams at each position, per order."""
    grams = chunk.grams(order)
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    if len(distinct) != len(counts):
        raise RuntimeError("a chunk's answers don't match its n-grams")
    return np.split(counts[inverse], order)


def frequency_class(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), at most CLASSES - 1."""
    return np.minimum(np.where(context > 0, np.frexp(np.maximum(context, 1).astype(float))[1], 0), CLASSES - 1)


class Model:
    """Totals and the learned weights: weights[m-1][frequency class]."""

    def __init__(self, order: int, tokens: int, documents: int, distinct: int, weights: list[np.ndarray]):
        self.order, self.tokens, self.documents, self.distinct, self.weights = order, tokens, documents, distinct, weights

    def levels(self, chunk: Chunk, counts: list[np.ndarray], upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For m = 1..upto: (maximum-likelihood estimate, P_(m-1), frequency class) at each position."""
        below = np.full(len(chunk.token), 1.0 / (self.distinct + 1))
        for m in range(1, upto + 1):
            if m == 1:
                context = np.full(len(chunk.token), self.tokens, np.int64)
            else:
                context = np.empty(len(chunk.token), np.int64)
                context[1:] = counts[m - 2][:-1]
                context[chunk.first] = self.documents
            estimate = np.where(context > 0, counts[m - 1] / np.maximum(context, 1), 0.0)
            group = frequency_class(context)
            yield estimate, below, group
            if m <= len(self.weights):
                a = np.where(context > 0, self.weights[m - 1][group], 0.0)
                below = a * estimate + (1 - a) * below
        self.probability = below


def _histogram(model: Model, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, BINS + 1), np.int64)
        for batch in batches:
            for row in W.rows(batch):
                chunk, counts, part = _opened(row)
                deleted = _aligned(chunk, model.order, counts - part)
                *_, (estimate, below, group) = model.levels(chunk, deleted, level)
                with np.errstate(divide="ignore"):
                    place = np.floor((np.log2(estimate / below) - LOWEST) * BINS_PER_OCTAVE)
                place = np.where(estimate > 0, np.clip(place, 0, BINS - 1), BINS).astype(np.int64)
                total += np.bincount(group * (BINS + 1) + place, minlength=total.size).reshape(total.shape)
        g, b = np.nonzero(total)
        yield pa.record_batch([pa.array(g, pa.int32()), pa.array(b, pa.int32()), pa.array(total[g, b])], names=["group", "bin", "n"])

    return run


def em(histogram: np.ndarray, steps: int = EM_STEPS) -> float:
    """The weight of the first of two distributions, from how often their ratio fell into each bin (the last
    bin: ratio 0)."""
    n = histogram.sum()
    if not n:
        return 0.5
    ratio = np.append(np.exp2((np.arange(BINS) + 0.5) / BINS_PER_OCTAVE + LOWEST), 0.0)
    a = 0.5
    for _ in range(steps):
        new = float((histogram * (a * ratio / (a * ratio + 1 - a))).sum() / n)
        new = min(max(new, 1e-6), 1 - 1e-6)
        if abs(new - a) < 1e-9:
            break
        a = new
    return a


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in W.rows(batch):
                chunk, counts, _ = _opened(row)
                aligned = _aligned(chunk, model.order, counts)
                for _ in model.levels(chunk, aligned, model.order):
                    pass
                known = aligned[0] > 0
                base = np.log10((aligned[0] + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
                sums = [np.add.reduceat(x, chunk.first) for x in (known.astype(np.int64), base, np.log10(model.probability))]
                n = len(row["ids"])
                yield pa.record_batch([
                    pa.array(row["ids"], pa.int64()), pa.array([row["role"] == HELD_OUT] * n), pa.array(chunk.n_tokens.astype(np.int64)), pa.array(sums[0]),
                    pa.array([model.tokens] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2]),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, order: int = ORDER, stored: bool = False, work: Workspace | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm")
    remainder = training_row(F.col("doc_id"), MODULUS)
    role = F.when(remainder == HELD_OUT, HELD_OUT).when(remainder == EM_PART, EM_PART).otherwise(2).cast("int")
    docs = docs.select("doc_id", "text") if stored else work.write(docs.select("doc_id", "text"), "documents")
    parts = bucket_count(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.alias("role"))

    asked = docs.mapInArrow(_ask(order, parts), "chunk long, role int, bucket int, keys binary, counts binary").repartitionById(parts, "bucket")
    answers = work.write(asked.mapInArrow(_answer, "chunk long, bucket int, counts binary, part binary, totals array<long>"), "answers")
    total = answers.filter("totals IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(3)]).first()
    trained = docs.agg(F.coalesce(F.sum((F.col("role") != HELD_OUT).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("role") == EM_PART).cast("long")), F.lit(0))).first()
    gathered = answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "part")).alias("answers"))

    carried = "chunk long, role int, ids array<long>, offsets array<long>, data binary"
    learning = docs.mapInArrow(_carry((EM_PART,)), carried).join(gathered, "chunk", "left")
    learning = work.write(learning, "learning")
    weights: list[np.ndarray] = []
    for level in range(1, order + 1):
        deleted = Model(order, total[1] - total[2], trained[0] - trained[1], total[0], weights)
        table = np.zeros((CLASSES, BINS + 1), np.int64)
        for r in learning.mapInArrow(_histogram(deleted, level), "group int, bin int, n long").groupBy("group", "bin").agg(F.sum("n").alias("n")).collect():
            table[r["group"], r["bin"]] = r["n"]
        weights.append(np.array([em(h) for h in table]))
    model = Model(order, total[1], trained[0], total[0], weights)
    everything = docs.mapInArrow(_carry((HELD_OUT, EM_PART, 2)), carried).join(gathered, "chunk", "left")
    return everything.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
