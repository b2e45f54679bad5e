"""Substring dedup: MinHash banding of paragraphs, verified by exact Jaccard, clustered by components.

A text's lines are its paragraphs, each the set of its five-word shingles.  Bands are tuned so that a pair at the
threshold collides with the wanted recall; paragraphs that collide are linked when the exact Jaccard similarity of
their sets reaches the threshold, and linked paragraphs form clusters.  Passages also stand inside unlike
paragraphs, so lines are cut where a word pair's hash is the smallest within three words on either side, in the same
line: the same passage is cut alike wherever it stands.  From each cut, the words to the next one (eight at least, if
the line has them) and the first eight of them are segments, which repeat when their words are equal.

The first occurrence of a segment or cluster (smallest doc_id, then place) is kept.  Overlapping and adjoining repeats
of a document are one passage, also across at most `GAP` words that match nothing where both sides are kept in the
same document, and `n_bridged` counts these words, so that a user who deletes passages knows; passages under `min_words` words (common lines, licences) are not reported.

Documents are read in chunks.  A chunk sends its distinct segments, with their first place in it, packed per bucket of
hashes; a bucket answers each chunk with those that other documents hold too.  So a line that every document holds
travels once per chunk, and passages are put together chunk by chunk.  Equal paragraphs are one class, so copies never
meet in pairs; the classes of a run (that share a band) are all compared, a bounded part of them with another at a time.

Defined results: null, empty and blank texts have no segments; paragraphs under five words are one shingle; repeats
inside one document alone are not reported; repeated rows are documents of their own with equal ids and repeat
each other only if they have different ids; rows with a null id are different documents, and a passage is kept there
only if no other row has it; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.components import components
from lexispark.llm.lm import packed, planes64, unpacked, unplanes64
from lexispark.llm.parity_join import JOB_SCHEMA, _verify, packed_set, run_jobs
from lexispark.llm.storage import Workspace, bucket_count

_U = np.uint64
SHINGLE, PERCENT = 5, 80
RECALL = 0.98
ROWS = 2  # hashes per band
MOST_BANDS = 16
RADIUS = 3  # words on either side of a cut that have larger hashes
SEGMENT = 8  # words of a segment
GAP = 32  # unmatched words within a passage: a changed word spoils the segments that hold it and those cut beside it
MIN_WORDS = 16
BROADCAST_CLASSES = 1_000_000  # 8 MB of class names
PART = 512  # members of a run that are compared at once with as many others
CHUNK_BYTES, CHUNK_SLICES = 4 << 20, 60
BUCKET_BYTES, LEAST_BUCKETS = 256 << 20, 96

_NONE, _ID, _FIRST = range(3)


def tune(percent: int, recall: float, rows: int = ROWS) -> int:
    """Bands of `rows` hashes for which a pair at the threshold collides with the wanted probability."""
    bands = math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1
    if bands > MOST_BANDS:
        raise ValueError(f"{percent} % needs {bands} bands of {rows} hashes for a recall of {recall}; a key names {MOST_BANDS} at most")
    return bands


class Segments:
    """The segments and paragraphs of a slice: document, first word within the document, length and fingerprint of
    each, and paragraphs' sorted shingle sets."""

    def __init__(self, s: W.Slice, size: int = SHINGLE):
        w = W.words(s)
        n = len(w.hash)
        line = np.cumsum(s.data == 10)[w.start] if n else np.empty(0, np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = (w.doc[1:] != w.doc[:-1]) | (line[1:] != line[:-1])
        number = np.cumsum(fresh)
        most = _U(2**64 - 1)
        pair = np.full(n, most, _U)
        pair[1:] = W.mix(w.hash[:-1] * _U(0x9FB21C651E98DF25) + w.hash[1:])
        pair[fresh] = most
        least = pair < most
        for k in range(1, RADIUS + 1):  # words of another line or document don't count
            apart = number[k:] != number[:-k]
            least[k:] &= apart | (pair[k:] < pair[:-k])
            least[:-k] &= apart | (pair[:-k] < pair[k:])
        begin, line = np.flatnonzero(fresh | least), np.flatnonzero(fresh)
        self.line_length = np.diff(np.append(line, n))
        line_end = np.repeat(line + self.line_length, self.line_length)[begin] if n else begin
        short = np.minimum(begin + SEGMENT, line_end)
        end = np.maximum(np.append(begin[1:], n), short) if n else begin
        begin, end = np.concatenate((begin, begin[end > short])), np.concatenate((end, short[end > short]))
        order = np.lexsort((end, begin))
        begin, end = begin[order], end[order]
        self.length = end - begin
        self.doc = w.doc[begin]
        self.first = begin - w.first[self.doc] if n else begin
        # a polynomial over the segment's words, from running sums as in W.words
        sums = np.concatenate(([_U(0)], np.cumsum(W.mix(w.hash) * W.powers(W._BASE, n), dtype=_U)))
        self.fp = W.mix((sums[end] - sums[begin]) * W.powers(W._INVERSE, n + 1)[begin] + self.length.astype(_U) * _U(0xD6E8FEB86659FD93))
        self.line_doc = w.doc[line]
        self.line_first = line - w.first[self.line_doc] if n else line
        # shingles of a paragraph, as if each were a document
        own = W.Words(w.start, w.end, np.repeat(np.arange(len(line)), self.line_length), w.hash, self.line_length)
        unit, h = W.shingles(own, size)
        order = np.lexsort((h, unit))
        unit, h = unit[order], h[order]
        distinct = np.ones(len(unit), bool)
        distinct[1:] = (unit[1:] != unit[:-1]) | (h[1:] != h[:-1])
        self.element, self.edge = h[distinct], np.searchsorted(unit[distinct], np.arange(len(line) + 1))
        self.set_size = np.diff(self.edge)
        sums = np.concatenate(([_U(0)], np.cumsum(W.mix(self.element + _U(0x51ED2701)), dtype=_U)))
        self.line_fp = W.mix((sums[self.edge[1:]] - sums[self.edge[:-1]]) ^ (self.set_size.astype(_U) * _U(0x9E3779B97F4A7C15)))

    def band_keys(self, bands: int, rows: int = ROWS) -> np.ndarray:
        """(bands, paragraphs): hash of `rows` minima each; the low bits name the band."""
        out = np.zeros((bands, len(self.line_fp)), _U)
        for b in range(bands if len(self.line_fp) else 0):
            for r in range(rows):
                salt = _U((b * rows + r + 1) * 0xA0761D6478BD642F & (2**64 - 1))
                out[b] = W.mix(out[b] * _U(0x9FB21C651E98DF25) + np.minimum.reduceat(W.mix(self.element ^ salt), self.edge[:-1]))
            out[b] = (out[b] & ~_U(MOST_BANDS - 1)) | _U(b)
        return out


def can_differ(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n shingles can reach the threshold with another set (one with a shingle more, at best)."""
    return n * (100 - percent) >= percent


CUT_SCHEMA = "kind int, chunk long, bucket int, doc_ids array<long>, parts array<binary>"


def _cut_rows(kind: int, chunk: int, rows: list[tuple[int | None, list, list[bytes]]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch([
        pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
        pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.binary())),
    ], names=["kind", "chunk", "bucket", "doc_ids", "parts"])


def owners(ids: list[int | None], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document (none, id): rows without an id come after all others and go by their place in the input."""
    none = np.array([x is None for x in ids], bool)
    return none, np.array([(chunk << 17) + k if x is None else x for k, x in enumerate(ids)], np.int64)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def relative(values: np.ndarray) -> bytes:
    """Longs as differences to the least of them, in front."""
    base = values.min(initial=0) if not len(values) else values.min()
    return np.int64(base).tobytes() + packed(values.view(_U) - np.array(base, np.int64).view(_U))


def absolute(raw: bytes) -> np.ndarray:
    return unpacked(raw[8:]) + np.frombuffer(raw, np.int64, 1)[0]


def sorted_keys(keys: np.ndarray) -> bytes:
    return planes64(np.diff(keys, prepend=_U(0)))


def unsorted_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes64(raw), dtype=_U)


def _cut(bands: int, percent: int, buckets: int):
    """Per chunk of documents: its segments and paragraphs (kind 0), and its paragraphs' band keys per bucket (1)."""

    def emit(chunk: int, ids: list, found: list[Segments], docs: list[int]) -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0, *docs[:-1]])
        whole = lambda name, by=None: np.concatenate([getattr(g, name) + (k if by else 0) for g, k in zip(found, shift, strict=True)])
        near, line_fp = can_differ(whole("set_size"), percent), whole("line_fp")
        parts = [packed(whole("doc", True)), packed(whole("first")), packed(whole("length")), whole("fp").tobytes()]
        parts += [packed(x[near]) for x in (whole("line_doc", True), whole("line_first"), whole("line_length"))] + [line_fp[near].tobytes()]
        yield _cut_rows(0, chunk, [(None, ids, parts)])
        keys = np.concatenate([g.band_keys(bands) for g in found], axis=1)[:, near]
        line_fp, once = np.unique(line_fp[near], return_index=True)  # equal paragraphs have equal keys
        keys = keys[:, once].ravel()
        bucket = bucket_of(keys, buckets)
        order = np.lexsort((keys, bucket))
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edge)).tolist():
            x = order[edge[b] : edge[b + 1]]
            rows.append((b, None, [sorted_keys(keys[x]), line_fp[x % len(line_fp)].tobytes()]))
        if rows:
            yield _cut_rows(1, chunk, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24  # the table is written once, so names stay
        ids, found, docs, size = [], [], [], 0
        for batch in batches:
            for s in W.slices(batch.column(1)):
                if found and (size + len(s.data) > CHUNK_BYTES or len(found) == CHUNK_SLICES):
                    yield from emit(chunk, ids, found, docs)
                    chunk, ids, found, docs, size = chunk + 1, [], [], [], 0
                ids.extend(batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()).to_pylist())
                found.append(Segments(s))
                docs.append(s.hi - s.lo)
                size += len(s.data)
        if found:
            yield from emit(chunk, ids, found, docs)

    return run


def _ask(buckets: int):
    """A chunk's distinct segments per bucket, with the first and the last document that holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in W.rows(batch):
                p, chunk = row["parts"], row["chunk"]
                none, own = owners(row["doc_ids"], chunk)
                doc, first, fp = unpacked(p[0]), unpacked(p[1]), np.frombuffer(p[3], _U)
                order = np.lexsort((first, own[doc], none[doc], fp))
                edge = np.flatnonzero(np.concatenate(([True], fp[order][1:] != fp[order][:-1]))) if len(fp) else order
                lead, last = order[edge], order[np.append(edge[1:], len(order)) - 1] if len(fp) else order
                cut = np.searchsorted(bucket_of(fp[lead], buckets), np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    x, y = lead[cut[b] : cut[b + 1]], last[cut[b] : cut[b + 1]]
                    rows.append((b, None, [sorted_keys(fp[x]), packed(none[doc[x]]), relative(own[doc[x]]), packed(first[x]), packed(none[doc[y]]), relative(own[doc[y]])]))
                if rows:
                    yield _cut_rows(2, chunk, rows)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one bucket: to each chunk, those of its segments that two documents hold, and where the first of them is."""
    asked, keys, firsts, lasts = [], [], [], []
    for batch in batches:
        for row in W.rows(batch):
            p = row["parts"]
            keys.append(unsorted_keys(p[0]))
            firsts.append((unpacked(p[1]), absolute(p[2]), unpacked(p[3])))
            lasts.append((unpacked(p[4]), absolute(p[5])))
            asked.append(row["chunk"])
    if not asked:
        return
    sizes = [len(k) for k in keys]
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    first, last = [np.concatenate(x) for x in zip(*firsts, strict=True)], [np.concatenate(x) for x in zip(*lasts, strict=True)]
    keys = firsts = lasts = None
    order = np.lexsort((first[_FIRST], first[_ID], first[_NONE], inverse))
    lead = order[np.searchsorted(inverse[order], np.arange(len(key)))]
    order = np.lexsort((last[_ID], last[_NONE], inverse))
    tail = order[np.searchsorted(inverse[order], np.arange(len(key)), "right") - 1]
    several = (first[_NONE][lead] != last[_NONE][tail]) | (first[_ID][lead] != last[_ID][tail])
    at = 0
    for chunk, n in zip(asked, sizes, strict=True):
        own = inverse[at : at + n]
        at += n
        own = own[several[own]]
        if len(own):
            x = lead[own]
            yield pa.record_batch([
                pa.array([chunk], pa.int64()), pa.array([[sorted_keys(key[own]), packed(first[_NONE][x]), relative(first[_ID][x]), packed(first[_FIRST][x])]], pa.list_(pa.binary())),
            ], names=["chunk", "answer"])


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, run, members) of every run of different classes that share a band.  A run's name is a hash of its members,
    so runs with the same members are one."""
    keys, fps = [], []
    for batch in batches:
        for row in W.rows(batch):
            keys.append(unsorted_keys(row["parts"][0]))
            fps.append(np.frombuffer(row["parts"][1], _U))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    keys = fps = None
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
    key, fp = key[fresh], fp[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    name = W.mix(np.add.reduceat(W.mix(fp), first) + count.astype(_U))
    keep = count > 1
    name, at = np.unique(name[keep], return_index=True)
    first, count = first[keep][at], count[keep][at]
    run = np.repeat(np.arange(len(name)), count)
    member = fp[np.arange(len(run)) - np.repeat(np.cumsum(count) - count - first, count)]
    yield pa.record_batch([pa.array(member.view(np.int64)), pa.array(name[run].view(np.int64)), pa.array(count[run].astype(np.int64))], names=["fp", "run", "members"])


def _sets(percent: int):
    """The shingle sets of paragraphs, each class once per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column(0)):
                g = Segments(s)
                _, once = np.unique(g.line_fp, return_index=True)
                once = once[can_differ(g.set_size[once], percent)]
                sets = [packed_set(g.element[g.edge[i] : g.edge[i + 1]]) for i in once]
                yield pa.record_batch([pa.array(g.line_fp[once].view(np.int64)), pa.array(sets, pa.binary())], names=["fp", "elements"])

    return run


def links(docs: DataFrame, pieces: DataFrame, percent: int, buckets: int, work: Workspace, part: int = PART) -> DataFrame:
    """(fp, root): linked paragraph classes with the smallest class they reach among those compared at once."""
    met = pieces.filter("kind = 1").select("bucket", "parts").repartitionById(buckets, "bucket").mapInArrow(_collide, "fp long, run long, members long")
    runs = work.write(work.write(met, "met").distinct(), "runs")
    near = work.write(runs.select("fp").distinct(), "near")
    few = near.count() <= BROADCAST_CLASSES
    sets = docs.select("text").mapInArrow(_sets(percent), "fp long, elements binary").join(F.broadcast(near) if few else near, "fp", "left_semi")
    sets = sets.groupBy("fp").agg(F.first("elements").alias("elements"))
    none = F.lit(None).cast("array<long>")
    ready = run_jobs(runs.withColumn("elsewhere", none), part).withColumn("run", F.lit(None).cast("long")).join(sets, "fp")
    ready = ready.withColumn("rep", F.col("fp")).withColumn("weight", F.lit(1)).withColumn("chunk", F.lit(0).cast("long")).withColumn("runs", none).select(*JOB_SCHEMA)
    ready = ready.repartition(buckets, "ca", "cb").sortWithinPartitions("ca", "cb")
    edges = work.write(ready.mapInArrow(_verify(percent), "fp long, root long, links long").select("fp", "root"), "similar")
    work.drop("met", "runs", "near")
    work.free()
    return edges


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One narrow row per paragraph that can differ from another: class, chunk, number in the chunk, owner, first word."""
    for batch in batches:
        for row in W.rows(batch):
            none, own = owners(row["doc_ids"], row["chunk"])
            doc, first = unpacked(row["parts"][4]), unpacked(row["parts"][5])
            n = len(doc)
            yield pa.record_batch([
                pa.array(np.frombuffer(row["parts"][7], np.int64)), pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n, dtype=np.int32)),
                pa.array(none[doc]), pa.array(own[doc]), pa.array(first),
            ], names=["fp", "chunk", "place", "none", "id", "first"])


def _passages(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in W.rows(batch):
                yield _chunk_passages(row, min_words)

    return run


def _chunk_passages(row: dict, min_words: int) -> pa.RecordBatch:
    """The passages of one chunk, from its segments, the answers about them, and its paragraphs in clusters."""
    p, ids = row["parts"], row["doc_ids"]
    none, own = owners(ids, row["chunk"])
    doc, first, length = (unpacked(p[i]) for i in range(3))
    answers = row["answers"] or []
    key = np.concatenate([np.empty(0, _U), *[unsorted_keys(a[0]) for a in answers]])
    order = np.argsort(key)
    empty = np.empty(0, np.int64)
    kept = [np.concatenate([empty, *[decode(a[i]) for a in answers]])[order] for i, decode in ((1, unpacked), (2, absolute), (3, unpacked))]
    key, fp = key[order], np.frombuffer(p[3], _U)
    at = np.minimum(np.searchsorted(key, fp), max(len(key) - 1, 0))
    hit = np.flatnonzero(key[at] == fp) if len(key) else empty
    at = at[hit]
    lines = row["lines"] or []
    line = np.array([x["place"] for x in lines], np.int64)
    line_doc, line_first, line_length = (unpacked(p[i])[line] for i in range(4, 7))
    of_line = lambda name: np.array([x[name] for x in lines], np.int64)
    units = [
        np.concatenate(x) for x in (
            (doc[hit], line_doc), (first[hit], line_first), (length[hit], line_length),
            (kept[_NONE][at], of_line("none")), (kept[_ID][at], of_line("id")), (kept[_FIRST][at], of_line("first")),
        )
    ]
    order = np.lexsort((-units[2], units[1], units[0]))
    out: list[list] = []
    last_doc, reach, reach_kept = -1, -1, None
    for d, word, n, k_none, k_id, k_first in zip(*(u[order].tolist() for u in units), strict=True):
        keeper, end = (k_none, k_id), word + n
        gap = word - reach
        if d != last_doc or gap > GAP or (gap > 0 and reach_kept != keeper):
            out.append([d, word, end, keeper, False, 0])
            gap = 0
        passage = out[-1]
        passage[5] += max(gap, 0)
        passage[2] = max(passage[2], end)
        passage[3] = min(passage[3], keeper)
        passage[4] |= keeper != (none[d], own[d]) or k_first != word
        if d != last_doc or (end, keeper) > (reach, reach_kept):
            last_doc, reach, reach_kept = d, end, keeper
    out = [x for x in out if x[2] - x[1] >= min_words]
    columns = [[ids[x[0]] for x in out], [x[1] for x in out], [x[2] for x in out], [x[2] - x[1] for x in out], [None if x[3][0] else x[3][1] for x in out]]
    return pa.record_batch(
        [*[pa.array(c, pa.int64()) for c in columns], pa.array([bool(x[4]) for x in out], pa.bool_()), pa.array([x[5] for x in out], pa.int64())],
        names=["doc_id", "first_word", "end_word", "n_words", "first_doc_id", "removed", "n_bridged"],
    )


def repeated_passages(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, min_words: int = MIN_WORDS, work: Workspace | None = None, part: int = PART) -> DataFrame:
    """doc_id, first_word, end_word, n_words, first_doc_id (where the passage is kept), removed, n_bridged (words in it that match nothing)."""
    work = work or Workspace(docs.sparkSession, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(docs, bucket_bytes=BUCKET_BYTES, least=LEAST_BUCKETS)
    pieces = work.write(docs.mapInArrow(_cut(tune(percent, recall), percent, buckets), CUT_SCHEMA), "pieces")
    edges = links(docs, pieces, percent, buckets, work, part)
    chunks = pieces.filter("kind = 0").select("chunk", "doc_ids", "parts")
    asked = chunks.mapInArrow(_ask(buckets), CUT_SCHEMA).select("chunk", "bucket", "parts").repartitionById(buckets, "bucket")
    answers = work.write(asked.mapInArrow(_answer, "chunk long, answer array<binary>"), "answers")

    groups = components(edges.select(F.col("fp").alias("u"), F.col("root").alias("v")), work).select(F.col("node").alias("fp"), F.col("component").alias("cluster"))
    paragraphs = chunks.mapInArrow(_paragraphs, "fp long, chunk long, place int, none boolean, id long, first long")
    # the joins are written apart from the aggregation, so that AQE may split a class or cluster that many documents share
    found = work.write(paragraphs.join(groups, "fp"), "found")
    place, own = F.struct("none", "id", "first"), F.struct("none", "id")
    keepers = found.groupBy("cluster").agg(F.min(place).alias("keeper"), F.max(own).alias("last_own")).filter("struct(keeper.none, keeper.id) < last_own")
    shared = work.write(found.join(work.write(keepers.select("cluster", "keeper"), "keepers"), "cluster").select("chunk", "place", "keeper.*"), "shared")

    by_chunk = answers.groupBy("chunk").agg(F.collect_list("answer").alias("answers"))
    lines = shared.groupBy("chunk").agg(F.collect_list(F.struct("place", "none", "id", "first")).alias("lines"))
    whole = chunks.join(by_chunk, "chunk", "left").join(lines, "chunk", "left").filter("answers IS NOT NULL OR lines IS NOT NULL")
    return whole.mapInArrow(_passages(min_words), "doc_id long, first_word long, end_word long, n_words long, first_doc_id long, removed boolean, n_bridged long")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
