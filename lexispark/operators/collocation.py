"""Collocates of a query, their statistics, examples and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import stats
from lexispark.functions.text import is_word, pos_class
from lexispark.operators.search import Hits, once
from lexispark.plans import pattern
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import margins, shared

KEY = ["word", "tag", "lemma"]


class Collocates:
    """Words within `window` tokens of a query's matches, in the corpus or in each group of the kept columns `by`.

    Distances count punctuation, punctuation itself is no collocate; where windows overlap, a token counts
    once for each match."""

    def __init__(
        self, corpus: Corpus, query: str, window: int = 5, min_observed: int = 1, word: str | None = None, tag: str | None = None, tags: list[str] | None = None,
        lemma: str | None = None, by: list[str] | None = None,
    ):
        self.corpus, self.window, self.min_observed, self.by = corpus, window, min_observed, by or []
        self.hits = Hits(corpus, query)
        if window + max(self.hits.length - 1, 0) > corpus.halo:
            raise ValueError("the window is wider than the corpus halo")
        self.word, self.tag, self.tags, self.lemma = word, tag, tags, lemma

    def _counted(self, first: bool = False, totals: bool = True) -> DataFrame:
        """(by, word, tag, lemma, obs_l, obs_r, nodes, total[, at, at_null]) of one pass over the corpus: the collocates of the matches;
        per word a row without tag and lemma with its `total`, whatever its tag; and per group a row without a word with
        the number of matches in `nodes`.  With `first`, `at` is the first unit that has the collocate, a null one if `at_null`:
        a plain value, as a struct would be sorted for instead of hashed.

        A stored corpus knows the totals already, so the pass takes the matches' surroundings only; so it does without `totals`."""
        left, right, node, total = (F.lit(k).cast("byte") for k in range(4))
        none = F.lit(None).cast("string")
        spot = lambda w, t, m, kind: F.struct(w.alias("word"), t.alias("tag"), m.alias("lemma"), kind.alias("kind"))

        def near(z: Column, found: Column) -> Column:
            def around(i: Column) -> Column:
                before, after = self.hits.around(z, i, self.window, self.window)
                one = lambda side: lambda x: spot(x["low"], x["tag"], x["lemma"], side)
                return F.concat(F.transform(before, one(left)), F.transform(after, one(right)), F.array(spot(none, none, none, node)))

            return F.flatten(F.transform(found, around))

        spots = once([F.arrays_zip("low", "tag", "lemma"), self.hits.found], near)
        stored = self.corpus.types is not None
        if totals and not stored:
            spots = F.concat(spots, F.transform(self.corpus.core("low")[0], lambda w: spot(w, none, none, total)))
        rows = self.corpus.blocks.select("unit_id", *self.by, F.explode(spots).alias("c")).select("unit_id", *self.by, "c.*")
        beside, null = F.col("kind") < 2, F.col("unit_id").isNull()
        earliest = [F.min(F.when(beside, F.col("unit_id"))).alias("at"), F.coalesce(F.max(beside & null), F.lit(False)).alias("at_null")] if first else []
        sums = [F.count_if(F.col("kind") == k).alias(name) for k, name in enumerate(("obs_l", "obs_r", "nodes", "total"))]
        counted = rows.groupBy(*self.by, *KEY).agg(*sums, *earliest)
        if totals and stored:
            zero = [F.lit(0).cast("long").alias(c) for c in ("obs_l", "obs_r", "nodes")]
            types = self.corpus.counted("low", by=self.by).select(*self.by, F.col("low").alias("word"), none.alias("tag"), none.alias("lemma"), *zero, F.col("n").alias("total"))
            counted = counted.unionByName(types, allowMissingColumns=True)
        return counted

    def _beside(self) -> DataFrame:
        """(unit_id, by, word, tag, lemma, line) of every token beside a match; line: pos, left, node, right."""

        def lines(token: Column, z: Column, found: Column) -> Column:
            def line(i: Column) -> Column:
                before, after = self.hits.around(token, i, self.window, self.window)
                texts = [F.array_join(x, " ").alias(c) for c, x in (("left", before), ("node", F.slice(token, i + 1, F.lit(self.hits.length))), ("right", after))]
                return F.struct(F.struct((F.col("start") + i).alias("pos"), *texts).alias("line"), F.concat(*self.hits.around(z, i, self.window, self.window)).alias("near"))

            return F.transform(found, line)

        found = F.explode(once([F.col("token"), F.arrays_zip("low", "tag", "lemma"), self.hits.found], lines)).alias("m")
        rows = self.corpus.blocks.select("unit_id", *self.by, found).select("unit_id", *self.by, "m.line", F.explode("m.near").alias("c"))
        return rows.select("unit_id", *self.by, F.col("c.low").alias("word"), "c.tag", "c.lemma", "line")

    @staticmethod
    def _collocates(counted: DataFrame) -> DataFrame:
        seen = counted.withColumn("observed", F.col("obs_l") + F.col("obs_r"))
        return seen.filter(is_word(F.col("word")) & (F.col("observed") > 0)).drop("nodes", "total")

    def counts(self) -> DataFrame:
        """(by,) word, tag, lemma, obs_l, obs_r, observed."""
        return self._collocates(self._counted(totals=False))

    @property
    def node_frequency(self) -> int:
        return self.hits.count

    def stats(self, first: bool = False) -> DataFrame:
        """counts() with total_freq (of the word, whatever its tag), ll, mi, significance and direction; N, the number of
        matches and the totals are those of the whole corpus or group, the filters touch group keys only.

        All parts come from one aggregate, whose shuffle is made once."""
        everything = shared(self._counted(first))
        counted = self._filtered(self._collocates(margins(everything, self.by, _nodes="nodes", _size="total")))
        names = {c: f"_by{k}" for k, c in enumerate(self.by)}
        totals = everything.filter("total > 0").select(*[F.col(c).alias(n) for c, n in names.items()], F.col("word").alias("_word"), F.col("total").alias("total_freq"))
        joined = counted.join(totals, [F.col("word") == F.col("_word"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]], "left").withColumn("total_freq", F.coalesce("total_freq", F.lit(0)))
        freq, size = F.col("_nodes"), F.col("_size")
        k11 = F.col("observed")
        k12, k21 = freq - k11, F.col("total_freq") - k11
        ll = stats.log_likelihood(k11, k12, k21, size - (k11 + k12 + k21))
        scored = joined.withColumn("_ll", ll).withColumn("mi", F.round(stats.mutual_information(k11, freq, F.col("total_freq"), size), 6))
        columns = [*self.by, *KEY, "obs_l", "obs_r", "observed", "total_freq", F.round("_ll", 6).alias("ll"), "mi", stats.significance(F.col("_ll")).alias("significance")]
        return scored.select(*columns, stats.direction(F.col("obs_l"), F.col("obs_r")).alias("direction"), *(["at", "at_null"] if first else []))

    def _filtered(self, counted: DataFrame) -> DataFrame:
        if self.min_observed > 1:
            counted = counted.filter(F.col("observed") >= self.min_observed)
        if self.word:
            counted = counted.filter(pattern.filter_pattern(F.col("word"), self.word))
        if (self.tag or self.tags or self.lemma) and self.corpus.raw:
            return counted.filter(F.lit(False))
        if self.tag:
            counted = counted.filter(pattern.any_of(F.col("tag"), self.tag))
        elif self.tags:
            counted = counted.filter(F.col("tag").isin(*self.tags))
        if self.lemma:
            counted = counted.filter(pattern.filter_pattern(F.col("lemma"), self.lemma))
        return counted

    def top(self, k: int = 20, rank: str = "ll") -> DataFrame:
        """The k best by `rank` ("ll" or "mi") of the corpus or of each group, with their rank; ties by word, tag, lemma."""
        return self._best(k, rank)

    def _best(self, k: int, rank: str, first: bool = False) -> DataFrame:
        order = [F.desc(rank), *KEY]
        place = F.row_number().over(Window.partitionBy(*self.by).orderBy(*order))
        rows = self.stats(first)
        if self.by:
            return rows.withColumn("rank", place).filter(F.col("rank") <= k)
        return rows.orderBy(*order).limit(k).withColumn("rank", place)

    def left(self, k: int = 20) -> DataFrame:
        return self.top(k).filter(F.col("direction").isin("L", "B"))

    def right(self, k: int = 20) -> DataFrame:
        return self.top(k).filter(F.col("direction").isin("R", "B"))

    def examples(self, k: int = 20, rank: str = "ll") -> DataFrame:
        """For each of the top k, the first match (in corpus order) that has it in its window.

        The pass that counts the collocates carries the first unit that has each; then those units are read, and the
        first lines cut out of them."""
        unit = F.when(~F.col("at_null"), F.col("at"))
        names = {c: f"_best{i}" for i, c in enumerate(["unit_id", *self.by, *KEY])}
        best = self._best(k, rank, first=True).select("rank", unit.alias(names["unit_id"]), *[F.col(c).alias(names[c]) for c in [*self.by, *KEY]])
        few = self.corpus.units(best.select(F.col(names["unit_id"]).alias("unit_id")))
        near = Collocates(few, self.hits.query, self.window, by=self.by)._beside()
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
        found = near.join(F.broadcast(best), same).groupBy("rank", "unit_id", *self.by, *KEY).agg(F.min("line").alias("line"))  # k rows, or k of each group
        return found.select(*self.by, "rank", *KEY, "unit_id", "line.pos", "line.left", "line.node", "line.right")

    def graph_edges(self, k: int = 20) -> DataFrame:
        return self.top(k).select(F.lit(self.hits.query).alias("source"), F.col("word").alias("target"), "tag", "lemma", F.col("ll").alias("weight"))

    def graph_nodes(self, k: int = 20) -> DataFrame:
        """Nodes with class, size scaled from 15 to 40 by ll, side and tooltip text."""
        best = self.top(k)
        whole = Window.partitionBy(F.lit(0))  # k rows
        low, high = F.min("ll").over(whole), F.max("ll").over(whole)
        size = F.when(high > low, 15 + (F.col("ll") - low) / (high - low) * 25).otherwise(25.0)
        tip = F.concat_ws("\n", F.concat(F.lit("POS: "), "tag"), F.format_string("Obs: %d (Left: %d, Right: %d)", "observed", "obs_l", "obs_r"), F.concat(F.lit("Dominant Direction: "), "direction"))
        side = F.when(F.col("direction") == "L", -1).when(F.col("direction") == "R", 1).otherwise(0)
        return best.select(F.col("word").alias("node"), "tag", "lemma", pos_class(F.col("tag")).alias("pos_class"), F.round(size, 3).alias("size"), side.alias("side"), tip.alias("tooltip"))
