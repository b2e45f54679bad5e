"""N-gram lists with positional filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import stats
from lexispark.functions.semantics import PER_MILLION
from lexispark.functions.text import is_word
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import cut, margins, shared, small_batches
from lexispark.plans.pattern import parse_term

CELLS = 1 << 25  # marks, sent to every task in 524,288 rows at most: about 20 MB
KEY_BITS = 40  # of a hash that the first pass counts
ROW_BITS = 14  # by which a key is shifted for its cell in the second row
BUCKETS = 1024  # of keys: one is counted at a time
HELD_KEYS = 1 << 21  # keys that a task holds before it hands them on


def _window(corpus: Corpus, n: int, names: list[str]) -> DataFrame:
    """One row per n-gram that begins in a core: n shifted slices of each array, zipped.  After a block's last n-gram
    comes a row without tokens that has the block's number of tokens in `_size`, so that sizes need no scan of their own."""
    if n - 1 > corpus.halo:
        raise ValueError(f"n-grams of {n} need a halo of {n - 1}; the corpus was built with {corpus.halo}")
    width = F.greatest(F.least(F.col("core_len"), F.size(names[0]) - F.col("core_from") - (n - 1)), F.lit(0))
    shifted = [F.slice(name, F.col("core_from") + 1 + k, width).alias(f"{name}{k}") for name in names for k in range(n)]
    size = F.concat(F.array_repeat(F.lit(None).cast("long"), width), F.array(F.col("core_len").cast("long"))).alias("_size")
    rows = corpus.blocks.select("unit_id", *corpus.keep, *shifted, size)
    zipped = F.explode(F.arrays_zip(*[f"{name}{k}" for name in names for k in range(n)], "_size")).alias("g")
    return rows.select(*corpus.keep, zipped).select(*corpus.keep, "g.*")


def _wanted(corpus: Corpus, n: int, filters: dict[int, str] | None, drop_punct: bool) -> DataFrame:
    """(kept columns, ngram, _size) of the n-grams that pass the filters, and the rows with a block's size."""
    wanted = {k: parse_term(p) for k, p in (filters or {}).items() if p.strip() and 1 <= k <= n}
    structural = any(t.structural for t in wanted.values())
    rows = _window(corpus, n, ["token", *(["tag", "lemma"] if structural else [])])
    passes = F.lit(not (structural and corpus.raw))
    for k, term in wanted.items():
        i = k - 1
        tag, lemma = (F.col(f"tag{i}"), F.col(f"lemma{i}")) if structural else (F.lit(None), F.lit(None))
        passes = passes & term.matches(F.lower(f"token{i}"), tag, lemma)
    if drop_punct:
        words: Column = F.lit(False)
        for i in range(n):
            words = words | is_word(F.lower(f"token{i}"))
        passes = passes & words
    parts = [F.col(f"token{i}") for i in range(n)]
    return rows.filter(F.col("_size").isNotNull() | passes).select(*corpus.keep, F.when(F.col("_size").isNull(), F.concat_ws(" ", *parts)).alias("ngram"), "_size")


def _listed(rows: DataFrame, by: list[str], per: int, minimum: int = 1) -> DataFrame:
    counted = shared(rows.groupBy(*by, "ngram").agg(F.count("*").alias("frequency"), F.sum("_size").alias("_size")))
    sized = margins(counted, by, _total="_size").filter(F.col("_size").isNull() & (F.col("frequency") >= minimum))
    return sized.select(*by, "ngram", "frequency", stats.relative_frequency(F.col("frequency"), F.col("_total"), per).alias("relative_frequency"))


def ngrams(corpus: Corpus, n: int, filters: dict[int, str] | None = None, drop_punct: bool = True, by: list[str] | None = None, per: int = PER_MILLION) -> DataFrame:
    """ngram (tokens as written), frequency, relative_frequency, in the corpus or in each group.

    `filters` maps a 1-based position to a term pattern; positions beyond n are ignored.  Filters touch the
    n-gram alone, so they run before the shuffle."""
    return _listed(_wanted(corpus, n, filters, drop_punct), by or [], per)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: those of small numbers are mostly zeros, which the shuffle's compression takes out."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _counted(minimum: int):
    """Hashes to (bucket, keys, counts): a task's different keys in their order, as gaps, with their counts."""
    most, edges = min(max(minimum, 1), 2**32 - 1), np.arange(BUCKETS + 1, dtype=np.uint64) * np.uint64((1 << KEY_BITS) // BUCKETS)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        n, at = np.minimum(n, most).astype(np.uint32), np.searchsorted(key, edges)
        ids = np.flatnonzero(np.diff(at))
        keys = [_planes(np.diff(key[at[b] : at[b + 1]], prepend=edges[b])) for b in ids]
        return pa.record_batch([pa.array(ids, pa.int32()), pa.array(keys, pa.binary()), pa.array([_planes(n[at[b] : at[b + 1]]) for b in ids], pa.binary())], names=["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS))
            if sum(map(len, held)) > HELD_KEYS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _full_cells(minimum: int, cells: int, depth: int):
    """Buckets of counted keys, in their order, to (word, bits): the cells of keys that have the minimum, 64 to a word."""

    def words(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        full = key[np.bincount(place, np.concatenate(counts)) >= minimum]
        cell = np.unique(np.concatenate([(full >> np.uint64(ROW_BITS * k)) % np.uint64(cells) + np.uint64(k * cells) for k in range(depth)]))
        word, first = np.unique(cell >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (cell & np.uint64(63)), first) if len(cell) else cell
        return pa.record_batch([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, counts = None, [], []
        for batch in batches:
            for bucket, gaps, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != here and keys:
                    yield words(keys, counts)
                    keys, counts = [], []
                here = bucket
                keys.append(np.cumsum(_numbers(gaps, np.uint64), dtype=np.uint64) + np.uint64(bucket) * np.uint64((1 << KEY_BITS) // BUCKETS))
                counts.append(_numbers(n, np.uint32))
        if keys:
            yield words(keys, counts)

    return run


def frequent(
    corpus: Corpus, n: int, minimum: int, filters: dict[int, str] | None = None, drop_punct: bool = True, by: list[str] | None = None, per: int = PER_MILLION, cells: int = CELLS, depth: int = 1,
) -> DataFrame:
    """`ngrams` of at least `minimum` occurrences, without shuffling the rare ones.

    A first pass counts 40 bits of the n-grams' hashes, packed into about three bytes each.  Those that have the minimum
    mark a cell in each of `depth` (1 or 2) rows of `cells` cells, by their bits.  An n-gram without its mark can't reach the
    minimum.  The marks go to every task, 64 to a row, so the second pass drops such n-grams where they stand and counts
    the rest exactly."""
    by = by or []
    rows = _wanted(corpus, n, filters, drop_punct)
    hashed = F.xxhash64("ngram", *by)
    counted = rows.filter("ngram IS NOT NULL").select(hashed.alias("h")).mapInArrow(_counted(minimum), "bucket int, keys binary, counts binary")
    marks = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_full_cells(minimum, cells, depth), "word long, bits long")
    with small_batches(rows.sparkSession, rows=1 << 16):  # of hashes: half a MB
        full = cut(marks.groupBy("word").agg(F.bit_or("bits").alias("bits")))
    kept = rows.withColumn("key", F.shiftrightunsigned(hashed, 64 - KEY_BITS))
    for k in range(depth):
        cell = F.shiftright("key", ROW_BITS * k) % cells + k * cells
        kept = kept.withColumn("cell", cell).withColumn("word", F.shiftright("cell", 6)).join(F.broadcast(full), "word", "left")
        # rows without an n-gram have a block's size
        kept = kept.filter(F.col("ngram").isNull() | (F.call_function("getbit", "bits", (F.col("cell") % 64).cast("int")) == 1)).drop("word", "bits", "cell")
    return _listed(kept.drop("key"), by, per, minimum)
