"""The corpus: token arrays in blocks with a halo.

A block holds `core_len` tokens of its own from index `core_from` on, and up to `halo` tokens of its
neighbours on each side.  Hits are taken from the core only and read their context from the whole array, so
searching, concordances, n-grams and collocations are narrow and nothing is counted twice.  A long unit is
several blocks.  With scope "corpus" all units form one sequence in the order of their ids.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.semantics import RAW_SHARE, UNTAGGED
from lexispark.functions.text import tokenize
from lexispark.plans.cut import cut, open_writers

BLOCK, HALO = 8192, 64
ROW_GROUP_BYTES = 16 << 20  # what a writer of blocks holds for each partition that it has open
ARRAYS = ["token", "low", "tag", "lemma", "sent"]


def _cut(units: DataFrame, keep: list[str], block: int, halo: int) -> DataFrame:
    """Blocks of units (unit_id, kept columns, arrays)."""
    n = F.size("token")
    blocks = units.select("unit_id", *keep, *ARRAYS, F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / block), F.lit(0)).cast("int"))).alias("block"))
    begin = F.col("block") * block
    first = F.greatest(begin - halo, F.lit(0))
    width = F.least(begin + block + halo, n) - first
    cut = lambda name: F.when((F.col("block") == 0) & (n <= block), F.col(name)).otherwise(F.slice(name, first + 1, F.greatest(width, F.lit(0)))).alias(name)
    return blocks.select(
        "unit_id", *keep, F.col("block").cast("long").alias("block"), first.cast("long").alias("start"), (begin - first).cast("int").alias("core_from"),
        F.greatest(F.least(F.lit(block), n - begin), F.lit(0)).cast("int").alias("core_len"), *[cut(a) for a in ARRAYS],
    )


class Corpus:
    """Blocks plus the facts that every analysis needs: size, and whether the corpus is raw.

    `types`, where a stored corpus has them, are its tokens counted by type: any of the kept columns, token, low, tag,
    lemma, and n.  Lists and totals then come from types and no token is read."""

    def __init__(self, blocks: DataFrame, keep: list[str], block: int = BLOCK, halo: int = HALO, raw: bool | None = None, types: DataFrame | None = None):
        self.blocks, self.keep, self.block, self.halo, self.types = blocks, keep, block, halo, types
        self._raw = raw

    # -- building -------------------------------------------------------------------------------------
    @classmethod
    def from_arrays(cls, units: DataFrame, keep: list[str] | None = None, block: int = BLOCK, halo: int = HALO, raw: bool | None = None) -> Corpus:
        """units: unit_id, token array, and optionally low, tag, lemma (string arrays) and sent (long array)."""
        keep = keep or []
        have = set(units.columns)
        n = F.size("token")
        filled = units.select(
            "unit_id", *keep, "token", F.col("low") if "low" in have else F.transform("token", F.lower).alias("low"),
            F.col("tag") if "tag" in have else F.array_repeat(F.lit(UNTAGGED), n).alias("tag"),
            F.col("lemma") if "lemma" in have else F.array_repeat(F.lit(UNTAGGED), n).alias("lemma"),
            F.col("sent") if "sent" in have else F.array_repeat(F.lit(0).cast("long"), n).alias("sent"),
        )
        return cls(_cut(filled, keep, block, halo), keep, block, halo, raw if "tag" in have else True)

    @classmethod
    def from_text(cls, df: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> Corpus:
        keep = keep or []
        return cls.from_arrays(df.select(F.col(id).alias("unit_id"), *keep, tokenize(F.col(text)).alias("token")), keep, **options)

    @classmethod
    def from_tokens(cls, tokens: DataFrame, keep: list[str] | None = None, **options) -> Corpus:
        """tokens: unit_id, pos, token, and optionally tag, lemma, sent_id; gathered per unit in order of pos."""
        keep = keep or []
        fields = [c for c in ("pos", "token", "tag", "lemma", "sent_id") if c in tokens.columns]
        units = tokens.groupBy("unit_id", *keep).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))
        names = {"sent_id": "sent"}
        return cls.from_arrays(units.select("unit_id", *keep, *[F.col(f"t.{c}").alias(names.get(c, c)) for c in fields if c != "pos"]), keep, **options)

    @classmethod
    def union(cls, corpora: dict[str, Corpus], label: str = "corpus") -> Corpus:
        """One corpus of several, each unit labelled with its corpus's name.  Columns that all of them keep are kept;
        unit ids of unlike types become strings.  Search, counts and concordances take the label as a kept column."""
        parts = list(corpora.values())
        keep = [c for c in parts[0].keep if all(c in p.keep for p in parts)]
        types = {p.blocks.schema["unit_id"].dataType.simpleString() for p in parts}
        unit = F.col("unit_id") if len(types) == 1 else F.col("unit_id").cast("string").alias("unit_id")
        block, halo = max(p.block for p in parts), min(p.halo for p in parts)
        raw = None if any(p._raw is None for p in parts) else parts[0]._raw if len({p._raw for p in parts}) == 1 else None
        rows = [p.blocks.select(F.lit(name).alias(label), unit, *keep, "block", "start", "core_from", "core_len", *ARRAYS) for name, p in corpora.items()]
        return cls(reduce(DataFrame.unionByName, rows), [label, *keep], block, halo, raw)

    def as_one_sequence(self, by: list[str] | None = None) -> Corpus:
        """Scope "corpus": one sequence over all units in the order of unit_id, or one for each group of the kept columns
        `by`, which the result keeps.

        Each block's own part is sliced for the new blocks that it reaches into, and those are put together: one
        shuffle of array slices, here only."""
        by = by or []
        own = self.blocks.filter("core_len > 0").select("unit_id", *by, (F.col("start") + F.col("core_from")).alias("pos"), "core_len", *self.core(*ARRAYS))
        own = self._with_starts(own, by).withColumn("begin", F.col("unit_start") + F.col("pos"))
        last = F.floor((F.col("begin") + F.col("core_len") - 1 + self.halo) / self.block)
        first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("begin") - self.halo) / self.block))
        home, block = F.col("home"), F.lit(self.block)
        low = F.greatest(F.col("begin"), home * block - self.halo)
        high = F.least(F.col("begin") + F.col("core_len"), (home + 1) * block + self.halo)
        inside = F.greatest(F.lit(0), F.least(high, (home + 1) * block) - F.greatest(low, home * block))
        slices = [F.slice(a, (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias(a) for a in ARRAYS]
        pieces = own.withColumn("home", F.explode(F.sequence(first, last))).filter(high > low).select(*by, "home", inside.alias("inside"), low.alias("low_pos"), *slices)
        # each array is gathered by itself, so those that the analysis doesn't read are not shuffled
        gathered = [F.array_sort(F.collect_list(F.struct("low_pos", F.col(a).alias("part")))).alias(a) for a in ARRAYS]
        packed = pieces.groupBy(*by, "home").agg(F.sum("inside").alias("core_len"), F.min("low_pos").alias("begin"), *gathered).filter("core_len > 0")
        begin = F.col("begin")
        blocks = packed.select(
            F.lit(0).cast("long").alias("unit_id"), *by, home.alias("block"), begin.alias("start"),
            (home * block - begin).cast("int").alias("core_from"), F.col("core_len").cast("int").alias("core_len"), *[F.flatten(F.col(f"{a}.part")).alias(a) for a in ARRAYS],
        )
        return Corpus(blocks, by, self.block, self.halo, self._raw)

    def around(self, few: DataFrame) -> Corpus:
        """The corpus of the blocks named by the rows of `few`: unit_id, and first, the position in the unit at which the
        block's own part begins.

        The rows become one scalar subquery, run once with the query that reads the corpus; its condition on units goes
        down to the source, so only those units are tokenised."""
        wanted = few.agg(F.struct(F.collect_list("unit_id").alias("ids"), F.collect_list(F.struct("unit_id", "first")).alias("keys"), F.coalesce(F.bool_or(F.col("unit_id").isNull()), F.lit(False)).alias("none"))).scalar()
        units = self.blocks.filter(F.array_contains(wanted["ids"], F.col("unit_id")) | (F.col("unit_id").isNull() & wanted["none"]))
        own = F.struct("unit_id", (F.col("start") + F.col("core_from")).cast("long").alias("first"))
        return Corpus(units.filter(F.array_contains(wanted["keys"], own)), self.keep, self.block, self.halo, self._raw, self.types)

    def units(self, few: DataFrame) -> Corpus:
        """The corpus of the units named by the rows of `few`: unit_id.  As in `around`, they are one scalar subquery."""
        wanted = few.agg(F.struct(F.collect_set("unit_id").alias("ids"), F.coalesce(F.bool_or(F.col("unit_id").isNull()), F.lit(False)).alias("none"))).scalar()
        units = self.blocks.filter(F.array_contains(wanted["ids"], F.col("unit_id")) | (F.col("unit_id").isNull() & wanted["none"]))
        return Corpus(units, self.keep, self.block, self.halo, self._raw, self.types)

    # -- views ----------------------------------------------------------------------------------------
    def core(self, *names: str) -> list[Column]:
        """The block's own part of the named arrays."""
        whole = (F.col("core_from") == 0) & (F.col("core_len") == F.size(names[0]))
        return [F.when(whole, F.col(n)).otherwise(F.slice(n, F.col("core_from") + 1, F.col("core_len"))).alias(n) for n in names]

    def tokens(self, *names: str) -> DataFrame:
        """One row per token: unit_id, kept columns, pos and the named attributes (default: all)."""
        names = names or tuple(ARRAYS)
        zipped = self.blocks.select("unit_id", *self.keep, (F.col("start") + F.col("core_from")).alias("first"), *self.core(*names))
        rows = zipped.select("unit_id", *self.keep, "first", F.posexplode(F.arrays_zip(*names)).alias("i", "t"))
        return rows.select("unit_id", *self.keep, (F.col("first") + F.col("i")).alias("pos"), *[F.col(f"t.{n}").alias(n) for n in names])

    def counted(self, *names: str, by: list[str] | None = None) -> DataFrame:
        """Tokens counted by kept columns and attributes: (*by, *names, n).  From the stored types if there are any."""
        keys = [*(by or []), *names]
        if self.types is not None and set(keys) <= set(self.types.columns):
            return self.types.groupBy(*keys).agg(F.sum("n").alias("n"))
        return self.tokens(*names).groupBy(*keys).agg(F.count("*").alias("n"))

    def _with_starts(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Rows with unit_start, the number of tokens in the units before (of the same group): by totals of ranges of
        units, then of units, so no task orders the corpus.  The ranges are written once, so that a lost task can't
        draw them anew."""
        sizes = cut(self.blocks.groupBy(*by, "unit_id").agg(F.sum("core_len").alias("n")))
        bins = max(1, math.isqrt(sizes.count()))  # as many units in a range as ranges
        ranged = cut(sizes.repartitionByRange(bins, *by, "unit_id").withColumn("bin", F.spark_partition_id()))
        names = {c: f"_by{k}" for k, c in enumerate(by)}
        same = lambda: [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
        renamed = [F.col(c).alias(n) for c, n in names.items()]
        totals = ranged.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*renamed, F.col("bin").alias("_bin"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bin_start"))
        inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = ranged.withColumn("inside", inside).join(F.broadcast(before), [F.col("bin") == F.col("_bin"), *same()]).select(*by, "unit_id", (F.col("bin_start") + F.col("inside")).alias("unit_start"))
        starts = placed.select(*renamed, F.col("unit_id").alias("_unit"), "unit_start")
        return rows.join(starts, [F.col("unit_id") == F.col("_unit"), *same()]).drop("_unit", *names.values())

    def positions(self) -> DataFrame:
        """tokens() with global_pos, the position in the sequence of all units."""
        return self._with_starts(self.tokens(), []).withColumn("global_pos", F.col("unit_start") + F.col("pos")).drop("unit_start")

    # -- facts ----------------------------------------------------------------------------------------
    @cached_property
    def size(self) -> int:
        if self.types is not None:
            return int(self.types.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        return int(self.blocks.agg(F.coalesce(F.sum("core_len"), F.lit(0))).first()[0])

    def raw_share(self) -> DataFrame:
        tags = self.counted("tag")
        untagged = F.sum(F.when(F.col("tag").contains(UNTAGGED), F.col("n")).otherwise(0))
        return tags.agg(F.coalesce(untagged / F.sum("n"), F.lit(1.0)).alias("share"))

    @cached_property
    def raw(self) -> bool:
        return self._raw if self._raw is not None else self.raw_share().first()[0] > RAW_SHARE

    def persist(self) -> Corpus:
        self.blocks = self.blocks.persist()
        return self

    def write(self, path: str, partition_by: list[str] | None = None) -> None:
        """Keep the blocks, by kept columns if wanted, and what `Corpus.read` needs to open them: block and halo
        size, whether the corpus is raw, its number of tokens."""
        writer = self.blocks.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
        with open_writers(self.blocks.sparkSession):
            writer.partitionBy(*(partition_by or [])).parquet(f"{path}/blocks")
        spark = self.blocks.sparkSession
        stored = Corpus(spark.read.parquet(f"{path}/blocks"), self.keep, self.block, self.halo, self._raw)
        facts = [(self.block, self.halo, stored.raw, stored.size, self.keep)]
        spark.createDataFrame(facts, "block int, halo int, raw boolean, size long, keep array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def read(cls, spark: SparkSession, path: str, raw: bool | None = None) -> Corpus:
        """A written corpus; `raw` overrules what was found when it was written."""
        facts = spark.read.parquet(f"{path}/facts").first()
        corpus = cls(spark.read.parquet(f"{path}/blocks"), facts["keep"], facts["block"], facts["halo"], facts["raw"] if raw is None else raw)
        corpus.size = facts["size"]
        return corpus
