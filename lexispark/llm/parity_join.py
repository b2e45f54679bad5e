"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles.  Its sketch has k blocks; every shingle is hashed to a
block and XORed into it, so the number of differing blocks (the Hamming distance of two sketches) is at most
the size of the symmetric difference of the sets.  Two linked sets of sizes n <= m differ in at most
d = (1-J)/(1+J) * (n+m) shingles; with k = d+1+slack blocks, at least 1+slack blocks agree (pigeonhole).

* Size bands: a band's partner is in the same or the next band, so each document writes its sketch for its
  own band and for the one before.
* Empty blocks agree without meaning anything and are not indexed.  A document with too many empty blocks
  for the guarantee is "open" under that hash seed and is indexed under the next seed too.  For any two
  documents there is a first seed under which one of them is not open; both are indexed there and agree in a
  block that is not empty.  So no pair is lost.
* Blocks are shipped as packed arrays per bucket of hashes, not as rows.  A bucket yields runs: the
  documents that share a block.  A run is written as its members, never as pairs.
* Verification: documents are gathered around the partner they share most blocks with, in chunks of bounded
  size, which are compared in full, in one matrix product.  Of two chunks that meet in runs, either all
  documents are compared, once, or those in each of the runs, whichever stands for fewer shingles.  A chunk travels
  as the union of its sets and places in it, which is short for near copies.

Exact copies (equal sets) are one class throughout.

Defined results: null, empty or blank text has an empty set, no links, and is its own component; a text of
fewer words than a shingle is one shingle; repeated rows are copies of each other.  Rows are told apart by a number of
their own: a null id links like any other and never becomes a component id (if all ids of a component are null, so is its
own); rows of one id with unlike texts have their own links, and may be in unlike components.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.components import components
from lexispark.llm.lm import packed, planes64, unpacked, unplanes64
from lexispark.llm.storage import Workspace, bucket_count

_U = np.uint64
SHINGLE = 4
PERCENT = 85
LEAST_PERCENT = 80
ID_BITS = 54  # of a shingle's hash; the bits above number the documents of a slice
CHUNK_DOCS = 1024  # near copies in a chunk: twice as many halve what the comparisons of a large cluster's chunks ship
RUN_DOCS = 256  # documents of a run's part, whose sets have no bound together
CHUNK_SHINGLES = 1_000_000
BROADCAST_IDS = 500_000  # at most 8 MB of candidate ids
BROADCAST_ROWS = 200_000  # at most 10 MB of what a set is compared for
WAVE_BYTES = 8 << 20  # for each bucket, of what comparisons ship at a time: less than the sketches of a bucket's text
SHINGLE_BYTES = 6  # of a set's element as it is shipped
STRONG = 1  # shared runs from which a link to a pivot is followed further
HUBS = 8  # of a cluster that is many chunks, where components only are wanted
FOLLOW = 4  # times the gathering is followed, each time twice as far
FLUSH_KEYS = 1 << 20
FLUSH_DOCS = 60_000  # a place in a blob has 16 bits


class Bands:
    """Size bands with, for each, the largest difference d of a linked pair and the number of blocks k."""

    def __init__(self, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"percent must be {LEAST_PERCENT} to 100: below, a band's difference leaves too many blocks empty")
        self.percent = percent
        self.start, self.d, self.k = [1], [], []
        # share of k blocks that stay empty in a band's smallest set, which fills them J * J / (1 - J) times or less
        self.empty, j = 0.01, percent / 100
        for _ in range(50 if percent < 100 else 0):
            self.empty = max(0.01, float(np.exp(-j * j / (1 - j) / (1 + self.empty))))

    def cover(self, n: int) -> None:
        while self.start[-1] <= n:
            lo = self.start[-1]
            hi = max(lo + 1, -(-lo * 100 // self.percent))
            d = (100 - self.percent) * (hi - 1 + (hi - 1) * 100 // self.percent) // (100 + self.percent)
            empty = self.empty * d
            self.start.append(hi)
            self.d.append(d)
            self.k.append(d + 1 + int(np.ceil(empty + 1.5 * np.sqrt(empty))))


def sets(s: W.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, elements): document i of the slice has the sorted distinct elements first[i]..first[i+1]."""
    doc, h = W.shingles(W.words(s), size)
    key = np.unique((doc.astype(_U) << _U(ID_BITS)) | (h >> _U(64 - ID_BITS)))
    first = np.searchsorted(key, np.arange(s.hi - s.lo + 1, dtype=_U) << _U(ID_BITS)) if s.hi - s.lo < 1 << (64 - ID_BITS) else None
    return first, key & _U((1 << ID_BITS) - 1)


def fingerprints(first: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """One 64-bit value per set, equal for equal sets."""
    n = np.diff(first)
    sums = np.concatenate(([_U(0)], np.cumsum(W.mix(elements + _U(0x51ED2701)), dtype=_U)))
    return W.mix((sums[first[1:]] - sums[first[:-1]]) ^ (n.astype(_U) * _U(0x9E3779B97F4A7C15)))


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column(1)):
                first, elements = sets(s, size)
                yield pa.record_batch([
                    *[batch.column(c).slice(s.lo, s.hi - s.lo).cast(pa.int64()) for c in (0, 2)], pa.array(np.diff(first).astype(np.int64)), pa.array(fingerprints(first, elements).view(np.int64)),
                ], names=["row", "id", "n", "fp"])

    return run


def _blocks(bands: Bands, band: np.ndarray, n: np.ndarray, first: np.ndarray, elements: np.ndarray, seed: int):
    """Sketch the given documents for the given bands: (row, key) of each non-empty block, and which rows are open."""
    k, d = np.array(bands.k)[band], np.array(bands.d)[band]
    base = np.concatenate(([0], np.cumsum(k)))
    owner = np.repeat(np.arange(len(n)), n)
    own = elements[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - first, n)]
    h = W.mix(own ^ _U((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    block = base[owner] + ((h >> _U(33)) * k[owner].astype(_U) >> _U(31)).astype(np.int64)
    sketch = np.zeros(base[-1], dtype=_U)
    np.bitwise_xor.at(sketch, block, W.mix(h + _U(0x2545F4914F6CDD1D)))
    used = np.bincount(block, minlength=base[-1]) > 0
    row = np.repeat(np.arange(len(n)), k)
    empty = k - np.bincount(row[used], minlength=len(n))
    at = np.flatnonzero(used)
    where = (at - base[row[at]]).astype(_U) + (band[row[at]].astype(_U) << _U(40)) + _U(seed << 56)
    return row[at], W.mix(sketch[at] ^ W.mix(where)), empty >= k - d


def _pack(keys: list[np.ndarray], docs: list[np.ndarray], fps: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One blob of keys per bucket, each key with the place of its document among the blob's fingerprints."""
    key, doc = np.concatenate(keys), np.concatenate(docs)
    bucket = ((key >> _U(48)) * _U(buckets) >> _U(16)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    blobs, names, ids = [], [], np.flatnonzero(np.diff(edge))
    for b in ids:
        part = order[edge[b] : edge[b + 1]]
        own, inverse = np.unique(doc[part], return_inverse=True)
        # 48 bits of key and 16 of the place in one long; sorted, so the gaps' high bytes compress away
        packed = np.sort((key[part] << _U(16)) | inverse.astype(_U))
        blobs.append(planes64(np.diff(packed, prepend=_U(0))))
        names.append(fps[own].tobytes())
    return pa.record_batch([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.array(names, pa.binary())], names=["bucket", "keys", "fps"])


def _sketch(size: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        keys, docs, fps = [], [], []
        n_docs = n_keys = 0
        for batch in batches:
            for s in W.slices(batch.column(0)):
                first, elements = sets(s, size)
                n = np.diff(first)
                fp = fingerprints(first, elements)
                _, firsts = np.unique(fp, return_index=True)
                picked = firsts[n[firsts] > 0]  # copies within a slice are sketched once
                if not len(picked):
                    continue
                bands.cover(int(n.max()))
                band = np.searchsorted(np.array(bands.start), n[picked], "right") - 1
                doc, band = np.concatenate((picked, picked[band > 0])), np.concatenate((band, band[band > 0] - 1))
                seed = 0
                while len(doc):
                    row, key, open_ = _blocks(bands, band, n[doc], first[doc], elements, seed)
                    keys.append(key)
                    docs.append(doc[row] + n_docs)
                    n_keys += len(key)
                    doc, band, seed = doc[open_], band[open_], seed + 1
                fps.append(fp)
                n_docs += len(fp)
                if n_keys > FLUSH_KEYS or n_docs > FLUSH_DOCS:
                    yield _pack(keys, docs, np.concatenate(fps), buckets)
                    keys, docs, fps = [], [], []
                    n_docs = n_keys = 0
        if keys:
            yield _pack(keys, docs, np.concatenate(fps), buckets)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of every run of one bucket that joins different sets; runs with the same members are one."""
    keys, fps = [], []
    for batch in batches:
        for k, f in zip(batch.column(1), batch.column(2), strict=True):
            both = np.cumsum(unplanes64(k.as_buffer()), dtype=_U)
            keys.append(both >> _U(16))
            fps.append(np.frombuffer(f.as_buffer(), _U)[(both & _U(0xFFFF)).astype(np.int64)])
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    keys = fps = None
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, fp = key[order][several], fp[order][several]
    if not len(key):
        return
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
    key, fp = key[fresh], fp[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    name = W.mix(np.add.reduceat(W.mix(fp), first) + count.astype(_U))
    keep = count > 1
    name, at, times = np.unique(name[keep], return_index=True, return_counts=True)
    first, count = first[keep][at], count[keep][at]
    for lo in range(0, len(name), 4096):
        f, c = first[lo : lo + 4096], count[lo : lo + 4096]
        run = np.repeat(np.arange(len(f)), c)
        member = fp[np.arange(len(run)) - np.repeat(np.cumsum(c) - c - f, c)]
        yield pa.record_batch([
            pa.array(name[lo : lo + 4096][run].view(np.int64)), pa.array(member.view(np.int64)), pa.array(fp[f][run].view(np.int64)), pa.array(times[lo : lo + 4096][run].astype(np.int64)),
        ], names=["run", "fp", "pivot", "times"])


def packed_set(elements: np.ndarray) -> bytes:
    """A sorted set as gaps, which have fewer bytes than hashes."""
    return packed(np.diff(elements, prepend=_U(0)))


def opened_set(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw).view(_U), dtype=_U)


def _sets_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column(0)):
                first, elements = sets(s, size)
                blobs = [packed_set(elements[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([pa.array(fingerprints(first, elements).view(np.int64)), pa.array(blobs, pa.binary())], names=["fp", "elements"])

    return run


def _overlaps(sets_: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets_)
    if m == 2:
        shared = len(np.intersect1d(sets_[0], sets_[1], assume_unique=True))
        return np.array([[len(sets_[0]), shared], [shared, len(sets_[1])]])
    owner = np.repeat(np.arange(m), [len(x) for x in sets_])
    _, column, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        x = np.zeros((m, 4096), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _share(runs: list[np.ndarray], below: int) -> np.ndarray:
    """Whether two documents have a compared run with a name under `below` in common."""
    owner, name = np.repeat(np.arange(len(runs)), [len(x) for x in runs]), np.concatenate(runs)
    owner, name = owner[name < below], name[name < below]
    names, column = np.unique(name, return_inverse=True)
    x = np.zeros((len(runs), len(names)), np.float32)
    x[owner, column] = 1
    return x @ x.T > 0


def _compare(run: int | None, rows: list[tuple], percent: int) -> Iterator[tuple[int, int, int]]:
    """(rep, smallest rep of its local component, weight of its links) for the linked documents of a job.

    A link is counted in one job only: in the chunk that holds both documents; else in the job of their two chunks,
    if there is one; else in the first of their common runs."""
    seen = dict.fromkeys((side, fp) for side, fp, *_ in rows)
    rows = [r for r in rows if seen.pop((r[0], r[1]), 0) is None]
    if len(rows) < 2:
        return
    side, rep, weight, chunk = (np.array([r[i] for r in rows]) for i in (0, 2, 3, 4))
    elements = [r[7] for r in rows]
    n = np.array([len(x) for x in elements])
    shared = _overlaps(elements)
    linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    linked &= (side[:, None] != side[None, :]) if side.any() else ~np.eye(len(rows), dtype=bool)
    if not linked.any():
        return
    label = rep.copy()
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            break
        label = least
    counted = linked
    if run is not None:
        elsewhere = chunk[:, None] == chunk[None, :]
        for i, r in enumerate(rows):
            elsewhere[i] |= np.isin(chunk, r[6])
        counted = linked & ~elsewhere & ~_share([r[5] for r in rows], run)
    weights = counted @ weight
    for i in np.flatnonzero(linked.any(axis=1)):
        yield int(rep[i]), int(label[i]), int(weights[i])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = (None, None, None), [], []

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["rep", "root", "links"])
            out.clear()
            return batch

        for batch in batches:
            runs, others, blobs = batch.columns[8:]
            longs = lambda x: np.asarray(x.values, np.int64) if x.is_valid else np.empty(0, np.int64)
            for i, (a, b, job, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:8]), strict=True)):
                if (a, b, job) != key:
                    out.extend(_compare(key[2], rows, percent))
                    key, rows = (a, b, job), []
                    if len(out) > 10_000:
                        yield flush()
                rows.append((*row, longs(runs[i]), longs(others[i]), opened_set(blobs[i].as_buffer())))
        out.extend(_compare(key[2], rows, percent))
        yield flush()

    return run


def pack(rep: np.ndarray, weight: np.ndarray, elements: list[np.ndarray]) -> list[bytes]:
    """A chunk's documents with the union of their sets in front: near copies share most of it, and a place in the union
    is far shorter than a hash."""
    union, place = np.unique(np.concatenate(elements), return_inverse=True)
    n = np.array([len(x) for x in elements])
    gaps = np.diff(place, prepend=0)
    first = np.cumsum(n) - n
    gaps[first] = place[first]
    return [rep.astype(np.int64).tobytes(), packed(weight), packed(n), packed_set(union), packed(gaps)]


class Pack:
    """An opened pack: rep, weight, n per document, the union, and owner and place in the union of every element."""

    def __init__(self, parts: list[bytes]):
        self.rep, self.weight, self.n, self.union = np.frombuffer(parts[0], np.int64), unpacked(parts[1]), unpacked(parts[2]), opened_set(parts[3])
        total = np.cumsum(unpacked(parts[4]))
        first = np.cumsum(self.n) - self.n
        before = np.concatenate(([0], total))[first]
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.place = total - before[self.owner]


def _compare_packs(a: Pack, b: Pack, percent: int) -> Iterator[tuple[int, int, int]]:
    """As _compare, for the documents of one chunk with those of another."""
    _, ia, ib = np.intersect1d(a.union, b.union, assume_unique=True, return_indices=True)
    sides = []
    for p, at in ((a, ia), (b, ib)):
        column = np.full(len(p.union), -1)
        column[at] = np.arange(len(at))
        column = column[p.place]
        owner, column = p.owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        sides.append((owner[order], column[order]))
    shared = np.zeros((len(a.n), len(b.n)))
    for lo in range(0, len(ia), 4096):
        x = []
        for (owner, column), p in zip(sides, (a, b), strict=True):
            i, j = np.searchsorted(column, (lo, lo + 4096))
            own = np.zeros((len(p.n), 4096), np.float32)
            own[owner[i:j], column[i:j] - lo] = 1
            x.append(own)
        shared += x[0] @ x[1].T
    shared = shared.astype(np.int64)
    linked = 100 * shared >= percent * (a.n[:, None] + b.n[None, :] - shared)
    if not linked.any():
        return
    most = np.iinfo(np.int64).max
    la, lb = a.rep.copy(), b.rep.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], most).min(axis=1))
        nb = np.minimum(lb, np.where(linked, na[:, None], most).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    for p, label, weights, some in ((a, la, linked @ b.weight, linked.any(axis=1)), (b, lb, linked.T @ a.weight, linked.any(axis=0))):
        for i in np.flatnonzero(some):
            yield int(p.rep[i]), int(label[i]), int(weights[i])


LINK = pa.struct([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _links(rows: list[tuple[int, int, int]]) -> list[dict]:
    return [{"rep": a, "root": b, "links": c} for a, b, c in rows]


def _chunks(percent: int):
    """Per chunk (rows sorted by it): the links among its documents, and its pack if it is compared with other chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, paired, rows = None, False, {}

        def flush() -> pa.RecordBatch:
            members = list(rows.values())
            found = _links(list(_compare(None, [(0, i, m[0], m[1], 0, None, None, m[2]) for i, m in enumerate(members)], percent)))
            parts = pack(np.array([m[0] for m in members]), np.array([m[1] for m in members]), [m[2] for m in members]) if paired else None
            return pa.record_batch([pa.array([key], pa.int64()), pa.array([found], pa.list_(LINK)), pa.array([parts], pa.list_(pa.binary()))], names=["chunk", "found", "parts"])

        for batch in batches:
            blobs = batch.column(5)
            for i, (chunk, with_others, fp, rep, weight) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)):
                if chunk != key:
                    if rows:
                        yield flush()
                    key, paired, rows = chunk, with_others, {}
                if fp not in rows:
                    rows[fp] = rep, weight, opened_set(blobs[i].as_buffer())
        if rows:
            yield flush()

    return run


def _meet(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in W.rows(batch):
                found = _links(list(_compare_packs(Pack(row["a"]), Pack(row["b"]), percent)))
                yield pa.record_batch([pa.array([found], pa.list_(LINK))], names=["found"])

    return run


#: Columns of what is compared: the job (ca, cb, and the run if it is one run's), the document's side, set, row, copies
#: and chunk, the runs in which it is compared, the chunks of the run that are compared elsewhere, and its elements.
JOB_SCHEMA = ["ca", "cb", "run", "side", "fp", "rep", "weight", "chunk", "runs", "elsewhere", "elements"]


def run_jobs(runs: DataFrame, chunk: int) -> DataFrame:
    """Each run's members (run, members, fp, and what else there is) in parts of about `chunk`; every two parts of a run, and every part alone, are a job."""
    splits = F.ceil(F.col("members") / chunk)
    cut = runs.withColumn("own", F.pmod(F.xxhash64("fp"), splits)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), splits - 1)))
    part = lambda c: F.when(F.col("members") <= chunk, F.col("run")).otherwise(F.xxhash64("run", c))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    return cut.select(part(F.least("own", "other")).alias("ca"), part(F.greatest("own", "other")).alias("cb"), side, *[c for c in runs.columns if c != "members"])


def ngram_jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, work: Workspace | None = None, stored: bool = False, links: bool = True, numbered: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, class_id (smallest id with an equal set), n_links
    (documents whose set is linked to this one's, copies included).

    Without `links`, the column n_links is left out, and a link between documents that other links join already need not be
    found: chunks are compared first, each with some documents of its whole cluster, and of the runs only those go on that
    still hold documents of several components.

    Rows are numbered by task and place, and texts of some are read again by that number.  A table read from files
    (`stored`) is numbered alike each time; any other input is written first.  With `numbered`, doc_id is a number of each
    row's own, and stands for it."""
    Bands(percent)
    spark = docs.sparkSession
    work = work or Workspace(spark, "parity-join")
    docs = docs.select("doc_id", "text") if stored else work.write(docs.select("doc_id", "text"), "documents")
    docs = docs.withColumn("row", F.col("doc_id") if numbered else F.monotonically_increasing_id())
    parts = bucket_count(docs)
    base = work.write(docs.select("row", "text", "doc_id").mapInArrow(_describe(size), "row long, id long, n long, fp long"), "base")
    packed = docs.select("text").mapInArrow(_sketch(size, percent, parts), "bucket int, keys binary, fps binary")
    runs = work.write(packed.repartitionById(parts, "bucket").mapInArrow(_runs, "run long, fp long, pivot long, times long"), "runs")
    work.free()

    classes = base.filter("n > 0").groupBy("fp").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count("*").alias("weight"), F.first("n").alias("n"))
    met = F.sum(F.when(F.col("fp") == F.col("pivot"), 0).otherwise(F.col("times"))).alias("met")
    nearest = runs.groupBy("fp", "pivot").agg(met).groupBy("fp").agg(F.max(F.struct("met", "pivot")).alias("best"))
    gathered = work.write(nearest.select("fp", F.col("best.pivot").alias("cluster"), (F.col("best.met") >= STRONG).alias("strong")), "nearest")
    for _ in range(FOLLOW):  # where the pivot itself has a strong pivot, gather around that one
        above = gathered.filter("strong").select(F.col("fp").alias("cluster"), F.col("cluster").alias("above"))
        gathered = gathered.join(above, "cluster", "left").select("fp", F.coalesce("above", "cluster").alias("cluster"), "strong")
    # a small cluster joins the largest one that it meets in a run, so the two are not compared chunk by chunk
    gathered = work.write(gathered.select("fp", "cluster"), "gathered")
    sizes = gathered.groupBy("cluster").agg(F.count("*").alias("docs"))
    met_in = runs.join(gathered, "fp").select("run", "cluster").distinct().join(sizes, "cluster")
    largest = met_in.groupBy("run").agg(F.max(F.struct("docs", "cluster")).alias("big"))
    # joins by cluster are stages of their own (their other side is written first), so that AQE may split a large cluster
    joins = work.write(met_in.join(largest, "run").groupBy("cluster").agg(F.max("big").alias("big")), "joins")
    gathered = gathered.join(joins, "cluster", "left").select("fp", F.coalesce("big.cluster", "cluster").alias("cluster"))
    members = work.write(gathered.join(classes.drop("least"), "fp"), "unsplit")
    splits = work.write(members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("splits")), "splits")
    members = members.join(splits, "cluster").select("fp", "rep", "weight", "n", F.xxhash64("cluster", F.pmod(F.xxhash64("fp"), F.col("splits"))).alias("chunk"))
    members = work.write(members, "members")

    def with_sets(rows: DataFrame) -> DataFrame:
        """`rows` (fp, rep and more) with their sets, from the text of each class's representative."""
        n, wanted = rows.count(), rows.select(F.col("rep").alias("row")).distinct()
        wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
        texts = docs.select("row", "text").join(wanted, "row", "left_semi").select("text").mapInArrow(_sets_of(size), "fp long, elements binary")
        return texts.join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, "fp")  # few rows go to the sets, which then move once

    link = "array<struct<rep:long,root:long,links:long>>"

    def of_chunks(rows: DataFrame) -> DataFrame:
        """(chunk, found, parts) of `rows` (chunk, paired, fp, rep, weight)."""
        alone = with_sets(rows).select("chunk", "paired", "fp", "rep", "weight", "elements").repartition(parts, "chunk").sortWithinPartitions("chunk")
        return alone.mapInArrow(_chunks(percent), f"chunk long, found {link}, parts array<binary>")

    opened = lambda rows: rows.select(F.explode("found").alias("x")).select("x.*")
    inside, placing = None, members.select("fp", "chunk", "n")
    if not links:
        whole = work.read("unsplit").select("fp", "rep", "weight", "cluster")
        split = work.read("splits").filter("splits > 1").select("cluster")
        hubs = whole.join(split, "cluster").groupBy("cluster", F.pmod(F.xxhash64("fp"), F.lit(HUBS))).agg(F.min(F.struct("fp", "rep", "weight")).alias("hub")).select("cluster", "hub.*")
        within = whole.join(split, "cluster").join(members.select("fp", "chunk"), "fp").select("cluster", "chunk").distinct()
        rows = members.select("chunk", "fp", "rep", "weight").unionByName(hubs.join(within, "cluster").select("chunk", "fp", "rep", "weight"))
        several = members.groupBy("chunk").count().filter("count > 1").select("chunk").unionByName(within.select("chunk")).distinct()
        rows = work.write(rows.join(several, "chunk", "left_semi").withColumn("paired", F.lit(False)), "with_hubs")
        inside = work.write(opened(of_chunks(rows)), "inside")
        work.drop("with_hubs")
        work.free()
        rounds = Workspace(spark, "parity-join-inside")
        joined = components(inside.select(F.col("rep").alias("u"), F.col("root").alias("v")), rounds)
        placing = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "chunk", "n", F.coalesce("component", "rep").alias("component"))
    work.drop("nearest", "gathered", "joins", "unsplit", "splits")
    work.free()

    # A run across chunks asks for their comparison.  Two chunks whose runs hold as many shingles together as the chunks
    # do are compared in full, once ("close"); for other chunks the members of each run are.
    placed = runs.join(placing, "fp")
    if not links:
        apart = placed.groupBy("run").agg(*[(F.min(c) < F.max(c)).alias(c) for c in ("chunk", "component")]).filter("chunk AND component")
        placed = placed.join(work.write(apart.select("run"), "apart"), "run", "left_semi")
    placed = work.write(placed.select("run", "fp", "chunk", "n"), "placed")
    if not links:  # other documents have nothing left to be compared with
        rounds.clear()
        members = work.write(members.join(placed.select("fp").distinct(), "fp", "left_semi"), "waiting")
    cross = placed.groupBy("run", "chunk").agg(F.sum("n").alias("n"))
    if links:  # else only runs across chunks are left
        cross = cross.join(cross.groupBy("run").count().filter("count > 1").select("run"), "run", "left_semi")
    cross = work.write(cross, "cross")
    a, b = cross.alias("a"), cross.alias("b")
    met_in = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.chunk") < F.col("b.chunk")))
    met_in = work.write(met_in.select("a.run", F.col("a.chunk").alias("ca"), F.col("b.chunk").alias("cb"), (F.col("a.n") + F.col("b.n")).alias("n")), "met")
    whole_size = members.groupBy("chunk").agg(F.sum("n").alias("size"))
    partners = met_in.groupBy("ca", "cb").agg(F.sum("n").alias("via"))
    for side in ("ca", "cb"):
        partners = partners.join(whole_size.select(F.col("chunk").alias(side), F.col("size").alias(f"size_{side}")), side)
    partners = work.write(partners.select("ca", "cb", (F.col("via") >= F.col("size_ca") + F.col("size_cb")).alias("close")), "partners")
    known = met_in.join(partners, ["ca", "cb"])
    partial = work.write(known.filter("NOT close").select("run").distinct(), "partial")  # other runs have nothing left to ask for
    both = known.join(partial, "run", "left_semi").select("run", "close", F.explode(F.array(F.struct(F.col("ca").alias("chunk"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("chunk"), F.col("ca").alias("other")))).alias("p"))
    asked = both.groupBy("run", "p.chunk").agg(F.collect_list(F.when(F.col("close"), F.col("p.other"))).alias("elsewhere"), F.count_if(~F.col("close")).alias("open")).filter("open > 0").drop("open")
    loose = work.write(placed.join(asked, ["run", "chunk"]).select("run", "fp", "n", "elsewhere"), "asked")
    loose = work.write(loose.join(loose.groupBy("run").agg(F.count("*").alias("members")), "run"), "loose")
    pairs = work.write(partners.filter("close").select("ca", "cb"), "pairs")
    paired = pairs.select(F.explode(F.array("ca", "cb")).alias("chunk")).distinct().withColumn("paired", F.lit(True))
    compared = members.groupBy("chunk").count().join(paired, "chunk", "left").filter("count > 1 OR paired").select("chunk", F.coalesce("paired", F.lit(False)).alias("paired"))
    work.drop("runs", "placed", "cross", "met", "partial", "asked")
    work.free()

    known_runs = loose.groupBy("fp").agg(F.sort_array(F.collect_list("run")).alias("runs"))  # at most one per block of a sketch
    narrow = members.join(compared, "chunk", "left").select("fp", "rep", "weight", "chunk", "paired")
    narrow = work.write(narrow.join(known_runs, "fp", "left"), "narrow")

    packs = work.write(of_chunks(narrow.filter("paired IS NOT NULL" if links else "paired")), "packs")
    work.free()
    side = lambda name, key: packs.filter("parts IS NOT NULL").select(F.col("chunk").alias(key), F.col("parts").alias(name))
    waves = lambda shipped, rows: max(1, -(-int(shipped or 0) // (parts * WAVE_BYTES)), -(-rows // BROADCAST_ROWS))
    of_wave = lambda rows, wave, most: rows.filter(F.pmod(F.xxhash64("ca", "cb"), F.lit(most)) == wave) if most > 1 else rows
    length = packs.filter("parts IS NOT NULL").select(F.col("chunk").alias("ca"), F.aggregate(F.transform("parts", F.octet_length), F.lit(0).cast("long"), lambda x, y: x + y).alias("length"))
    meets = waves(*pairs.join(length, "ca").agg(F.sum("length"), F.count("*")).first())

    def meeting(wave: int) -> DataFrame:
        few = F.broadcast(of_wave(pairs, wave, meets))  # about BROADCAST_ROWS of them
        return opened(side("a", "ca").join(few, "ca").join(side("b", "cb"), "cb").select("a", "b").mapInArrow(_meet(percent), f"found {link}"))

    meet = in_waves(work, "of_chunks", meets, meeting)
    meet = meet.unionByName(opened(packs.select("found"))) if links else meet.unionByName(inside)
    if links:
        meet = work.write(meet, "of_chunks")
    work.drop("packs")
    work.free()
    times = F.ceil(F.col("members") / RUN_DOCS)
    jobs, verified = run_jobs(loose, RUN_DOCS), waves(loose.agg(SHINGLE_BYTES * F.sum(F.col("n") * times)).first()[0], 0)
    sets_ = with_sets(narrow.filter("runs IS NOT NULL"))
    sets_ = work.write(sets_, "sets") if verified > 1 else sets_

    def verifying(wave: int) -> DataFrame:
        own = of_wave(jobs, wave, verified)
        own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
        ready = sets_.join(own, "fp").select(*JOB_SCHEMA).repartition(parts, "ca", "cb").sortWithinPartitions("ca", "cb", "run")
        return ready.mapInArrow(_verify(percent), "rep long, root long, links long")

    of_runs = in_waves(work, "of_runs", verified, verifying)
    linked = work.write(meet.unionByName(of_runs), "linked")
    work.drop("inside", "apart", "waiting", "pairs", "members", "partners", "loose", "narrow", "sets", *(t for t in work.tables if t.startswith(("of_chunks", "of_runs"))))
    work.free()

    found = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")), work)
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    # components are of rows; each is named by the smallest id in it
    placed = classes.select("fp", "rep", "least", "weight").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    placed = work.write(placed, "placed_classes")
    smallest = work.write(placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    out = base.join(placed.join(smallest, "component", "left"), "fp", "left")
    n_links = (F.coalesce(F.col("weight"), F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("smallest", "least", "id").alias("component_id"),
        F.coalesce("least", "id").alias("class_id"), *([n_links] if links else []),
    )


def in_waves(work: Workspace, name: str, waves: int, rows: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of all waves.  Each is written by itself and its shuffle goes before the next one's, so what comparisons ship
    together, which may grow with the square of a cluster, doesn't lie on the disks at a time."""
    written = []
    for wave in range(waves):
        written.append(work.write(rows(wave), f"{name}{wave}"))
        work.free()
    return reduce(DataFrame.unionByName, written)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
