"""Benchmark decontamination by a positional inverted index over the training documents.

`build_index` stores, for each block of documents, every term's posting list: the sorted word positions of
the term in the block.  Blocks are independent, so building and searching are narrow jobs whatever the
corpus size.  `search` sends the test windows to every block; a window starts from the posting list of its
rarest term there and keeps the places where each next-rarest term occurs at the right offset.  Proximity
matches start from the rarest term too and take any order of the terms within the window's length plus `slop`.

Test windows travel to the executors in parts of at most `part_bytes` of text, one pass over the index per
part, so no broadcast and no task grows with the benchmark.

Defined results: null and empty texts have no words, no hits and n_items 0; an item without words matches
nothing; a null item id reads as the empty string; repeated documents are reported once per row; repeated
item ids count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.storage import Workspace

WINDOW = 10
SLOP = 2  # words beyond a window's length in which its terms count as near each other
BLOCK_BYTES = 1 << 20
PART_BYTES = 8 << 20

INDEX_SCHEMA = "block long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, positions binary"
HIT_SCHEMA = "block long, slot int, doc_id long, n_words int, hits array<int>, items array<string>, near array<string>"


def planes(values: np.ndarray) -> bytes:
    """uint32 values byte plane by byte plane: high planes of small numbers are runs of zeros."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32  # blocks of equal documents stay apart; the index is written once
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for s in W.slices(batch.column(1), BLOCK_BYTES):
            w = W.words(s, W.ALPHANUMERIC)
            position = np.arange(len(w.hash)) + w.doc  # one empty place between documents
            order = np.argsort(w.hash, kind="stable")
            terms, first, counts = np.unique(w.hash[order], return_index=True, return_counts=True)
            gaps = np.diff(position[order], prepend=0)
            gaps[first] = position[order][first]
            own = ids.slice(s.lo, s.hi - s.lo)
            block += 1
            yield pa.record_batch([
                pa.array([block], pa.int64()), pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([w.per_doc.tolist()], pa.list_(pa.int32())),
                pa.array([terms.tobytes()], pa.binary()), pa.array([planes(counts)], pa.binary()), pa.array([planes(gaps)], pa.binary()),
            ], names=["block", "doc_ids", "n_words", "terms", "counts", "positions"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: its ids, word counts and the posting list of every term."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_index_batches, INDEX_SCHEMA)


class Windows:
    """The distinct windows of some test items: a matrix of term numbers (-1 beyond the length), and the items of each."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        rows, owner = [np.zeros((0, size), np.uint64)], []
        lengths: list[np.ndarray] = []
        for item, text in items:
            h = W.words(next(W.slices(pa.array([text], pa.string()), 1 << 62)), W.ALPHANUMERIC).hash
            if not len(h):
                continue
            own = np.lib.stride_tricks.sliding_window_view(h, size) if len(h) >= size else np.pad(h, (0, size - len(h)))[None]
            rows.append(own)
            owner.append(np.full(len(own), number[item]))
            lengths.append(np.full(len(own), min(len(h), size)))
        everything, length = np.concatenate(rows), np.concatenate([np.zeros(0, np.int64), *lengths])
        self.terms, at = np.unique(everything, return_inverse=True)
        matrix = at.reshape(everything.shape).astype(np.int32)
        matrix[np.arange(size) >= length[:, None]] = -1
        self.matrix, row = np.unique(matrix, axis=0, return_inverse=True)
        self.length = (self.matrix >= 0).sum(axis=1)
        pair = np.unique(np.stack((row.ravel(), np.concatenate([np.zeros(0, np.int64), *owner]))), axis=1)
        self.item = pair[1]
        self.item_edge = np.searchsorted(pair[0], np.arange(len(self.matrix) + 1))

    def items_of(self, doc: np.ndarray, window: np.ndarray, docs: int) -> list[list[str]]:
        """Per document, the sorted names of the items of its windows."""
        found = np.unique(np.stack((doc, window)), axis=1)
        n = self.item_edge[found[1] + 1] - self.item_edge[found[1]]
        item = self.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.item_edge[found[1]], n)]
        both = np.unique(np.stack((np.repeat(found[0], n), item)), axis=1)
        edge = np.searchsorted(both[0], np.arange(docs + 1))
        return [[self.names[k] for k in both[1, a:b].tolist()] for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Postings:
    """One index block, opened for search."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, n_words: list[int]):
        self.terms = np.frombuffer(terms, np.uint64)
        counts_ = unplanes(counts)
        self.first = np.concatenate(([0], np.cumsum(counts_)))
        gaps = unplanes(positions)
        total = np.cumsum(gaps)
        before = np.concatenate(([0], total))[self.first[:-1]]
        self.positions = total - np.repeat(before, counts_)
        self.doc_start = np.concatenate(([0], np.cumsum(np.asarray(n_words, np.int64) + 1)))
        self.term_at = np.full(int(self.doc_start[-1]) + 1, -1, np.int64)
        self.term_at[self.positions] = np.repeat(np.arange(len(self.terms)), counts_)

    def local(self, terms: np.ndarray) -> np.ndarray:
        """This block's number of each term, -1 where it does not occur."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `terms`, position) of every posting of every given term."""
        n = self.first[terms + 1] - self.first[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        return owner, self.positions[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - self.first[terms], n)]

    def candidates(self, windows: Windows, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, its terms here, their offsets from rare to frequent, position of the rarest) of every place where
        the rarest term of a window occurs, about `most` at once.  Windows with a term that the block lacks are left out."""
        local = self.local(windows.terms)
        matrix = np.where(windows.matrix >= 0, local[windows.matrix], -2) if len(local) else windows.matrix.astype(np.int64)
        alive = np.flatnonzero((matrix != -1).all(axis=1) & (windows.length > 0))
        matrix = matrix[alive]
        frequency = np.where(matrix >= 0, self.first[matrix + 1] - self.first[matrix], np.iinfo(np.int64).max)
        rank = np.argsort(frequency, axis=1, kind="stable")
        work = np.cumsum(np.take_along_axis(frequency, rank[:, :1], 1).ravel()) if len(alive) else np.empty(0)
        lo = 0
        while lo < len(alive):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most, "right")))
            row, position = self.expand(matrix[np.arange(lo, hi), rank[lo:hi, 0]])
            yield alive[lo + row], matrix[lo + row], rank[lo + row], position
            lo = hi

    def phrases(self, windows: Windows, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of each exact phrase: the lists of the rarer terms, adjusted by their offsets, first."""
        for window, matrix, rank, position in self.candidates(windows, most):
            start = position - rank[:, 0]
            keep = np.flatnonzero(start >= 0)
            for r in range(1, windows.size):
                offset = rank[keep, r]
                term = matrix[keep, offset]
                keep = keep[(term == -2) | (self.term_at[np.minimum(start[keep] + offset, len(self.term_at) - 1)] == term)]
            yield window[keep], start[keep]

    def near(self, windows: Windows, slop: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, document) where length + slop consecutive words hold all terms of the window in any order.

        Such a run holds an occurrence of the rarest term; of any other term only the nearest occurrences before and
        after that one matter, and the run may be taken to begin at one of those before."""
        big = len(self.term_at) + 1
        flat = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * big + self.positions
        for window, matrix, rank, position in self.candidates(windows, most):
            doc = np.searchsorted(self.doc_start, position, "right") - 1
            span = windows.length[window] + slop
            low, high = np.maximum(self.doc_start[doc], position - span + 1), np.minimum(self.doc_start[doc + 1] - 1, position + span)
            keep = np.arange(len(window))
            sides: list[tuple[np.ndarray, np.ndarray]] = []
            for r in range(1, windows.size):
                term, at = matrix[keep, rank[keep, r]], position[keep]
                any_, t = term == -2, np.maximum(term, 0)
                k = np.searchsorted(flat, t * big + at)
                before = np.where(any_, at, np.where(k > self.first[t], flat[np.maximum(k - 1, 0)] - t * big, -1))
                after = np.where(any_, at, np.where(k < self.first[t + 1], flat[np.minimum(k, len(flat) - 1)] - t * big, big))
                ok = (before >= low[keep]) | (after < high[keep])
                sides = [(b[ok], a[ok]) for b, a in [*sides, (before, after)]]
                keep = keep[ok]
            found = np.zeros(len(keep), bool)
            for start in [position[keep], *[b for b, _ in sides]]:
                ok = start >= low[keep]
                end = np.minimum(start + span[keep], high[keep])
                for b, a in sides:
                    ok &= (b >= start) | (a < end)
                found |= ok
            yield window[keep[found]], doc[keep[found]]


def _search_batches(windows: Windows, slop: int, hits_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in W.rows(batch):
                p = Postings(row["terms"], row["counts"], row["positions"], row["n_words"])
                n = len(row["doc_ids"])
                cover = np.zeros(len(p.term_at) + 1 + windows.size, np.int64)
                exact = [(np.empty(0, np.int64), np.empty(0, np.int64))]
                for window, start in p.phrases(windows):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + windows.length[window], -1)
                    exact.append((window, np.searchsorted(p.doc_start, start, "right") - 1))
                window, doc = (np.concatenate([x[i] for x in exact]) for i in (0, 1))
                items = windows.items_of(doc, window, n)
                close = [(window, doc), *p.near(windows, slop)]
                near = windows.items_of(np.concatenate([x[1] for x in close]), np.concatenate([x[0] for x in close]), n)
                at = np.flatnonzero(np.cumsum(cover) > 0)
                edge = np.searchsorted(at, p.doc_start)
                hits = [(at[a:b] - s).tolist() for a, b, s in zip(edge[:-1], edge[1:], p.doc_start.tolist(), strict=False)]
                slot = [d for d in range(n) if near[d] or not hits_only]
                take = lambda values: [values[d] for d in slot]
                yield pa.record_batch([
                    pa.array([row["block"]] * len(slot), pa.int64()), pa.array(slot, pa.int32()), pa.array(take(row["doc_ids"]), pa.int64()), pa.array(take(row["n_words"]), pa.int32()),
                    pa.array(take(hits), pa.list_(pa.int32())), pa.array(take(items), pa.list_(pa.string())), pa.array(take(near), pa.list_(pa.string())),
                ], names=["block", "slot", "doc_id", "n_words", "hits", "items", "near"])

    return run


def item_parts(benchmark: DataFrame, part_bytes: int, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The benchmark cut into parts of roughly at most `part_bytes` of text each."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // part_bytes)
    return [items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, part_bytes: int = PART_BYTES, work: Workspace | None = None) -> DataFrame:
    """Per indexed document: doc_id, n_words, hits (positions of words inside exact matches), items (ids of items with
    exact matches, sorted), near (ids of items with proximity matches, those with exact ones included).

    Of several parts, each is searched and its findings are written before the next one is read, so the driver and
    the tasks hold one part at a time."""
    parts = item_parts(benchmark, part_bytes)
    windows = lambda part: Windows([(r["item"], r["text"]) for r in part.toLocalIterator()], size)  # noqa: E731  (one part, at most part_bytes)
    columns = ["doc_id", "n_words", "hits", "items", "near"]
    if len(parts) == 1:
        return index.mapInArrow(_search_batches(windows(parts[0]), slop, False), HIT_SCHEMA).select(*columns)
    work = work or Workspace(index.sparkSession, "contamination")
    found = reduce(DataFrame.unionByName, [work.write(index.mapInArrow(_search_batches(windows(part), slop, True), HIT_SCHEMA), f"part{k}") for k, part in enumerate(parts)])
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = found.groupBy("block", "slot").agg(*[all_of(c) for c in columns[2:]])
    every = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("slot", "d")).select("block", "slot", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return every.join(merged, ["block", "slot"], "left").select("doc_id", "n_words", none("hits", "int"), none("items", "string"), none("near", "string"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, part_bytes: int = PART_BYTES, work: Workspace | None = None) -> DataFrame:
    """Index `docs`, search every window of `benchmark`, and report each document's hits."""
    work = work or Workspace(docs.sparkSession, "contamination")
    return search(work.write(build_index(docs), "index"), benchmark, size, slop, part_bytes, work)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near", ",").cast("binary"), 256).alias("near_sha256"),
    )
