"""A corpus kept in files, which grows by appends: blocks, a positional index, types and distinct-count sketches.

    path/blocks/part=X     blocks in the order of block_id, in small pages, so that a few of them are read by themselves
    path/postings/part=X   (kind, term, block) -> places; in the order of terms, so that a term or a prefix is read by itself
    path/types/part=X      (grouping columns, token, low, tag, lemma, n): an appended part's tokens counted by type
    path/sketches/part=X   (grouping columns, n_tokens, words, lemmas): sketches of the distinct words and lemmas
    path/facts/part=X      what a part holds; written last, so a part that was not finished is not seen

An append adds a part and rewrites nothing.  Counts add up and sketches unite over parts when they are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.semantics import RAW_SHARE, UNTAGGED
from lexispark.functions.text import is_word
from lexispark.operators.search import Hits
from lexispark.plans import pattern
from lexispark.plans.corpus import ARRAYS, Corpus
from lexispark.plans.cut import cut, small_batches

PAGE_BLOCKS = 16  # blocks in a page of a file: what is read at least
ROW_GROUP_BYTES = 4 << 20  # a reader decodes a row group's arrays at once, to about ten times their size
FEW_BLOCKS = 100_000  # up to so many wanted blocks are named to the scan
SPANS = 200  # in ranges of at most so many
TYPE = ["token", "low", "tag", "lemma"]
HELD_TYPES = 400_000  # types that a task counts before it hands them on
RANGE_TOKENS = 100_000  # of postings in a range, at least
SAMPLE = 100  # types drawn for a range
SKETCH_K = 14  # log2 of a sketch's registers; errors of about 1 %

FACTS = "part string, tokens long, untagged long, block int, halo int, indexed boolean, lemmas boolean, keep array<string>, by array<string>"


def _postings(kinds: list[str], carried: list[str], bounds: dict[str, list[str]]):
    """Blocks to (carried columns, kind, term, n_core, at, bucket): a term's places in the block counted from the block's own part
    on, `n_core` of them within it and the rest in the halo behind, and the range that it is dealt to.  `bounds` are the
    terms of a kind at which a range begins; a term at which several begin is dealt to all of these by block."""
    before = {kind: sum(len(bounds[k]) for k in kinds[:i]) for i, kind in enumerate(kinds)}

    def buckets(kind: str, terms: pa.Array, ids: pa.Array) -> pa.Array:
        if not bounds[kind]:
            return pa.array(np.full(len(terms), before[kind]), pa.int32())
        encoded = terms.dictionary_encode()
        names = np.array([x.lower() if kind == "lemma" else x for x in encoded.dictionary.to_pylist()], object)
        low, high = (np.searchsorted(np.array(bounds[kind], object), names, side)[encoded.indices.to_numpy()] for side in ("left", "right"))
        several = high - low
        spread = ids.to_numpy() % np.maximum(several, 1) + 1
        return pa.array(before[kind] + low + np.where(several > 0, spread, 0), pa.int32())

    def of_block(tokens: pa.Array, core_from: int, core_len: int) -> tuple[pa.Array, np.ndarray, pa.ListArray]:
        encoded = pc.fill_null(tokens.slice(core_from), "").dictionary_encode()
        codes, n = encoded.indices.to_numpy(), len(encoded.dictionary)
        ends = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n))))
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.argsort(codes, kind="stable"), pa.int32()))
        return encoded.dictionary, np.bincount(codes[:core_len], minlength=n), places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in kinds:
                starts, lengths = (batch.column(c).to_pylist() for c in ("core_from", "core_len"))
                parts = [of_block(batch.column(kind)[i].values, starts[i], lengths[i]) for i in range(batch.num_rows) if lengths[i] > 0]
                if not parts:
                    continue
                kept = pa.array(np.repeat(np.flatnonzero(np.array(lengths) > 0), [len(p[0]) for p in parts]))
                terms, places = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 2))
                core = pa.array(np.concatenate([p[1] for p in parts]), pa.int32())
                columns, terms = [batch.column(c).take(kept) for c in carried], terms.cast(pa.string())
                bucket = buckets(kind, terms, columns[carried.index("block_id")])
                yield pa.record_batch([*columns, pa.array([kind] * len(terms), pa.string()), terms, core, places, bucket], names=[*carried, "kind", "term", "n_core", "at", "bucket"])

    return run


def _type_counts(by: list[str]):
    """Blocks to (by, token, low, tag, lemma, n), counted per task in tables of bounded size."""
    keys = [*by, *TYPE]

    def counted(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

    def of_batch(batch: pa.RecordBatch) -> pa.Table:
        starts, lengths = (batch.column(c).to_numpy() for c in ("core_from", "core_len"))
        row = np.repeat(np.arange(batch.num_rows), lengths)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        columns = [batch.column(c).take(pa.array(row)) for c in by]
        for name in TYPE:
            lists = batch.column(name)
            at = lists.offsets.to_numpy()[:-1] + starts
            columns.append(lists.values.take(pa.array(np.repeat(at, lengths) + inside)))
        return counted([pa.table([*columns, pa.array(np.ones(len(row), np.int64))], names=[*keys, "n"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(of_batch(batch))
            if sum(t.num_rows for t in held) > HELD_TYPES:
                held = [counted(held)]
                if held[0].num_rows > HELD_TYPES // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
        if held:
            yield from counted(held).combine_chunks().to_batches()

    return run


def _bounds(types: DataFrame, kinds: list[str]) -> dict[str, list[str]]:
    """The terms at which the postings' ranges begin, one for each of the session's partitions and no more than there are
    RANGE_TOKENS: each range has about as many tokens.  They come from the types, of which about SAMPLE rows for a range are
    drawn by their counts, so no posting is made for it."""
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * len(kinds)
    ranges = max(1, min(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_TOKENS))
    if ranges == 1:
        return {kind: [] for kind in kinds}
    each = total / (ranges * SAMPLE)
    term = {"low": F.col("low"), "lemma": F.lower("lemma")}
    rows = types.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(term[k], F.lit("")).alias("term")) for k in kinds])).alias("x")).groupBy("x").agg(F.sum("n").alias("n"))
    drawn = rows.select("x.*", F.floor(F.col("n") / each + F.pmod(F.xxhash64("x"), F.lit(1 << 20)) / (1 << 20)).cast("long").alias("n")).filter("n > 0")
    drawn = sorted(tuple(r) for r in drawn.collect())  # about ranges * SAMPLE at most
    ends = np.cumsum([n for *_, n in drawn])
    found: dict[str, list[str]] = {kind: [] for kind in kinds}
    for at in np.searchsorted(ends, np.arange(1, ranges) * SAMPLE, "right"):
        if at < len(drawn):
            found[drawn[at][0]].append(drawn[at][1])
    return found


def spans(ids: list[int], most: int = SPANS, page: int = PAGE_BLOCKS) -> list[tuple[int, int]]:
    """Ranges that cover the ids: apart where a page or more lies between them, but no more than `most`."""
    ids = np.unique(np.array(ids, np.int64))
    if not len(ids):
        return []
    gaps = np.diff(ids)
    breaks = np.flatnonzero(gaps > page)
    if len(breaks) >= most:
        breaks = np.sort(breaks[np.argsort(gaps[breaks], kind="stable")[len(breaks) - most + 1 :]])
    first, last = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(ids) - 1]))
    return list(zip(ids[first].tolist(), ids[last].tolist(), strict=True))


class Store:
    """An opened store.  `append` adds a part; open the store again, or use its result, to see it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.facts = sorted(spark.read.schema(FACTS).parquet(f"{path}/facts/*").collect())  # a row for each part
        first = self.facts[0]
        self.block, self.halo, self.indexed, self.keep, self.by = first["block"], first["halo"], first["indexed"], first["keep"], first["by"]

    @classmethod
    def create(cls, path: str, corpus: Corpus, by: list[str] | None = None, index: bool = True) -> Store:
        """A store with `corpus` as its first part.  `by` are the kept columns by which types and sketches are grouped; they
        should have few values."""
        return cls._add(path, corpus, by or [], index)

    def append(self, corpus: Corpus) -> Store:
        """Add a corpus with other units, cut alike and with the same kept columns."""
        if (corpus.block, corpus.halo, corpus.keep) != (self.block, self.halo, self.keep):
            raise ValueError(f"the store has blocks of {self.block} with halo {self.halo} and keeps {self.keep}")
        return self._add(self.path, corpus, self.by, self.indexed)

    @classmethod
    def _add(cls, path: str, corpus: Corpus, by: list[str], index: bool) -> Store:
        if not set(by) <= set(corpus.keep):
            raise ValueError(f"the corpus keeps {corpus.keep} only")
        spark, part, keep = corpus.blocks.sparkSession, f"p{uuid.uuid4().hex[:12]}", corpus.keep
        at = lambda table: f"{path}/{table}/part={part}"
        rows = corpus.blocks.select(F.monotonically_increasing_id().alias("block_id"), "unit_id", *keep, "block", "start", "core_from", "core_len", *ARRAYS)
        rows.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_BLOCKS).option("parquet.block.size", ROW_GROUP_BYTES).parquet(at("blocks"))
        blocks = spark.read.schema(rows.schema).parquet(at("blocks"))
        counts = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], *[f"{c} string" for c in TYPE], "n long"])
        types = blocks.select(*by, "core_from", "core_len", *TYPE).mapInArrow(_type_counts(by), counts).groupBy(*by, *TYPE).agg(F.sum("n").alias("n"))
        with small_batches(spark):
            types.sortWithinPartitions("low").write.option("compression", "zstd").parquet(at("types"))
        types = spark.read.schema(types.schema).parquet(at("types"))
        sketch = lambda c: F.hll_sketch_agg(c, SKETCH_K)
        sketches = types.groupBy(*by).agg(F.sum("n").alias("n_tokens"), sketch(F.when(is_word(F.col("low")), F.col("low"))).alias("words"), sketch(F.col("lemma")).alias("lemmas"))
        sketches.write.parquet(at("sketches"))
        lemmas = index and corpus._raw is not True  # a raw corpus has none
        if index:
            carried = ["block_id", "unit_id", *keep, "first"]
            cut_out = blocks.select("block_id", "unit_id", *keep, (F.col("start") + F.col("core_from")).alias("first"), "core_from", "core_len", "low", "lemma")
            schema = ", ".join(f"`{c}` {cut_out.schema[c].dataType.simpleString()}" for c in carried) + ", kind string, term string, n_core int, at array<int>, bucket int"
            kinds = ["lemma", "low"] if lemmas else ["low"]
            bounds = _bounds(types, kinds)
            places = cut_out.mapInArrow(_postings(kinds, carried, bounds), schema).withColumn("term", F.when(F.col("kind") == "lemma", F.lower("term")).otherwise(F.col("term")))
            # by ranges of terms, so a very frequent term is dealt over many files
            dealt = places.repartitionById(sum(map(len, bounds.values())) + 1, "bucket").drop("bucket").sortWithinPartitions("kind", "term", "block_id")
            with small_batches(spark):
                dealt.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(at("postings"))
        untagged = F.sum(F.when(F.col("tag").contains(UNTAGGED), F.col("n")).otherwise(0))
        total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(untagged, F.lit(0)).alias("untagged")).first()
        fact = [(part, total["tokens"], total["untagged"], corpus.block, corpus.halo, index, lemmas, keep, by)]
        spark.createDataFrame(fact, FACTS).coalesce(1).write.parquet(at("facts"))
        return cls(spark, path)

    # -- tables ---------------------------------------------------------------------------------------
    def _table(self, name: str) -> DataFrame:
        """The finished parts of a table; others are never listed."""
        paths = [f"{self.path}/{name}/part={f['part']}" for f in self.facts]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)

    @cached_property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    @cached_property
    def types(self) -> DataFrame:
        return self._table("types").drop("part")

    @property
    def tokens(self) -> int:
        return sum(f["tokens"] for f in self.facts)

    @property
    def raw(self) -> bool:
        return not self.tokens or sum(f["untagged"] for f in self.facts) > RAW_SHARE * self.tokens

    def _corpus(self, blocks: DataFrame) -> Corpus:
        corpus = Corpus(blocks, self.keep, self.block, self.halo, self.raw, self.types)
        corpus.size = self.tokens
        return corpus

    @property
    def corpus(self) -> Corpus:
        """All parts as one corpus, whose lists and totals come from the types."""
        return self._corpus(self.blocks)

    # -- the index ------------------------------------------------------------------------------------
    def _places(self, term: pattern.Term) -> DataFrame | None:
        """The index's rows for a word or lemma (the tag of a term is not indexed); None if the index can't tell."""
        kind, wanted = ("low", term.word) if term.word is not None else ("lemma", term.lemma)
        if not self.indexed or not wanted or not wanted.strip("*") or (kind == "lemma" and not all(f["lemmas"] for f in self.facts)):
            return None
        return self._table("postings").filter((F.col("kind") == kind) & pattern.wildcard(F.col("term"), wanted))

    def _matches(self, terms: list[pattern.Term]) -> DataFrame | None:
        """(part, block_id, unit_id, kept columns, first, at): the places in a block where all indexed terms stand at their
        distances; a row for each block that has any."""
        key, facts = ["part", "block_id"], ["unit_id", *self.keep, "first"]
        found = None
        for k, term in enumerate(terms):
            rows = self._places(term)
            if rows is None:
                continue
            place = F.slice("at", 1, F.col("n_core")) if k == 0 else F.col("at")  # a match begins in the block's own part
            rows = rows.groupBy(*key).agg(*[F.first(c).alias(c) for c in facts], F.flatten(F.collect_list(place)).alias("at"))
            rows = rows.withColumn("at", F.transform("at", lambda x: x - k))
            if found is None:
                found = rows
            else:
                found = found.join(rows.select(*key, F.col("at").alias("_at")), key).withColumn("at", F.array_intersect("at", "_at")).drop("_at")
        return None if found is None else found.filter(F.size("at") > 0)

    def _alone(self, terms: list[pattern.Term]) -> bool:
        """Whether the index alone answers: words and lemmas without tags, none of them a bare `*`."""
        return bool(terms) and all(t.tag is None and self._places(t) is not None for t in terms)

    def _spots(self, terms: list[pattern.Term]) -> DataFrame:
        rows = self._matches(terms)
        if self.raw and any(t.structural for t in terms):
            rows = rows.filter(F.lit(False))
        return rows.select("part", "block_id", "unit_id", *self.keep, "first", F.explode("at").alias("i")).withColumn("pos", F.col("first") + F.col("i"))

    def positions(self, query: str) -> DataFrame:
        """`Hits.positions` from the index: no block is read unless the query has tags, then those that can match."""
        terms = pattern.parse(query)
        if len(terms) > self.halo:
            raise ValueError("the query is longer than the corpus halo")
        if not self._alone(terms):
            return Hits(self.narrow(query), query).positions()
        return self._spots(terms).select("unit_id", *self.keep, "pos", F.lit(len(terms)).alias("len"))

    def narrow(self, query: str) -> Corpus:
        """The corpus without the blocks in which, by the index, the query can't match.  Sizes and totals stay those of the
        whole corpus.  The blocks are looked up when this is called."""
        terms = pattern.parse(query)
        if self.raw and any(t.structural for t in terms):
            return self._corpus(self.blocks.filter(F.lit(False)))
        found = self._matches(terms)
        return self.corpus if found is None else self._only(found.select("part", "block_id"))

    def kwic(self, query: str, limit: int | None = 100, sample_seed: int | None = None, **options) -> DataFrame:
        """`Hits.kwic`; where the index alone knows the matches, those of the first lines are put in order by it and only
        their blocks are read."""
        terms = pattern.parse(query)
        if limit is None or options.get("near") or options.get("near_tag") or not self._alone(terms):
            return Hits(self.narrow(query), query).kwic(limit=limit, sample_seed=sample_seed, **options)
        first = Hits._limited(self._spots(terms), limit, sample_seed)
        return Hits(self._only(first.select("part", "block_id")), query).kwic(limit=limit, sample_seed=sample_seed, **options)

    def _only(self, keys: DataFrame) -> Corpus:
        """The corpus of the blocks with the given keys.  Few are named to the scan, as ranges that files, row groups and
        pages outside are skipped by."""
        keys = cut(keys.distinct())
        if keys.count() > FEW_BLOCKS:
            return self._corpus(self.blocks.join(keys, ["part", "block_id"], "left_semi"))
        wanted: dict[str, list[int]] = {}
        for part, block in keys.collect():
            wanted.setdefault(part, []).append(block)
        ranges = [(F.col("part") == p) & F.col("block_id").between(a, b) for p, ids in wanted.items() for a, b in spans(ids)]
        inside: Column = reduce(lambda x, y: x | y, ranges, F.lit(False))
        return self._corpus(self.blocks.filter(inside).join(F.broadcast(keys), ["part", "block_id"], "left_semi"))

    # -- sketches -------------------------------------------------------------------------------------
    def summary_estimate(self, by: list[str] | None = None) -> DataFrame:
        """`frequency.summary` from the sketches: exact n_tokens, n_types and n_lemmas within about 1 %.  `by` may be any of the
        store's grouping columns: sketches unite over the others."""
        union = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
        return self._table("sketches").groupBy(*(by or [])).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), union("words").alias("n_types"), union("lemmas").alias("n_lemmas"))
