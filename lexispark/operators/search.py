"""Searching: query string -> hits, their counts, and concordance lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import stats
from lexispark.functions.semantics import NO_TRANSLATION, PER_MILLION, UNTAGGED
from lexispark.plans import pattern
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import margins, shared

FEW_LINES = 1_000  # up to so many lines of a concordance, positions are put in order before lines are cut out


def once(columns: list[Column], use: Callable[..., Column]) -> Column:
    """use(*columns) with each column evaluated once per row: inside a lambda, an expression that the optimiser puts in
    place of a column would be evaluated for every element."""
    held = F.array(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]))
    return F.transform(held, lambda s: use(*[s[f"c{k}"] for k in range(len(columns))]))[0]


class Hits:
    """Places where a query matches.

    What an analysis wants of a match (a form, its context, its collocates) is cut out of the block where the match is
    found, so only narrow rows leave the block, never its arrays."""

    def __init__(self, corpus: Corpus, query: str):
        self.corpus, self.query = corpus, query
        self.terms = pattern.parse(query)
        self.length = len(self.terms)
        if self.length > corpus.halo:
            raise ValueError("the query is longer than the corpus halo")

    @property
    def found(self) -> Column:
        """The indices in a block's arrays at which matches begin."""
        if not self.terms:
            return F.array().cast("array<int>")
        structural = any(t.structural for t in self.terms)
        test = pattern.at(self.terms, self.corpus.raw if structural else False)
        indices = F.when(F.col("core_len") > 0, F.sequence(F.col("core_from"), F.col("core_from") + F.col("core_len") - 1)).otherwise(F.array().cast("array<int>"))
        names = ("low", "tag", "lemma") if structural else ("low",)

        def matches(*arrays: Column) -> Column:
            held = dict(zip(names, arrays, strict=True))
            return F.filter(indices, lambda i: test(i, lambda name, k: F.get(held[name], i + k) if name in held else F.lit(None)))

        return once([F.col(n) for n in names], matches)

    def each(self, names: list[str], make: Callable[[dict[str, Column], Column], Column]) -> Column:
        """array of make(arrays, i), for the named arrays and the index i of each match."""
        return once([*[F.col(n) for n in names], self.found], lambda *held: F.transform(held[-1], lambda i: make(dict(zip(names, held, strict=False)), i)))

    def around(self, array: Column, i: Column, left: int, right: int) -> tuple[Column, Column]:
        """The array's `left` elements before the match at i and `right` elements after it."""
        first = F.greatest(i - left, F.lit(0))
        return F.slice(array, first + 1, i - first), F.slice(array, i + self.length + 1, F.lit(right))

    @cached_property
    def count(self) -> int:
        return int(self.corpus.blocks.agg(F.coalesce(F.sum(F.size(self.found)), F.lit(0))).first()[0])

    def positions(self) -> DataFrame:
        rows = self.corpus.blocks.select("unit_id", *self.corpus.keep, "start", F.explode(self.found).alias("i"))
        return rows.select("unit_id", *self.corpus.keep, (F.col("start") + F.col("i")).alias("pos"), F.lit(self.length).alias("len"))

    def breakdown(self, per: int = PER_MILLION, by: list[str] | None = None) -> DataFrame:
        """Matched forms (first token, as written) with frequency, relative frequency, Zipf score and band, in the corpus
        or in each group.  Each block adds a row with its number of tokens, so sizes need no scan of their own."""
        by = by or []
        row = lambda token, hit, size: F.struct(token.alias("token"), hit.alias("hit"), size.alias("size"))
        forms = self.each(["token"], lambda a, i: row(F.get(a["token"], i), F.lit(1), F.lit(0)))
        block = F.array(row(F.lit(None).cast("string"), F.lit(0), F.col("core_len")))
        rows = self.corpus.blocks.select(*by, F.explode(F.concat(forms, block)).alias("r")).select(*by, "r.*")
        counted = shared(rows.groupBy(*by, "token").agg(F.sum("hit").alias("frequency"), F.sum("size").alias("size")))
        freq = margins(counted, by, _size="size").filter("frequency > 0")
        freq = freq.select(*by, "token", "frequency", stats.relative_frequency(F.col("frequency"), F.col("_size"), per).alias("relative_frequency"))
        return freq.withColumn("zipf", stats.zipf(F.col("relative_frequency"))).withColumn("band", stats.zipf_band(F.col("zipf")))

    def _check(self, left: int, right: int) -> None:
        """A match may begin at the last token of a block's own part, so the halo holds its rest and what follows."""
        if max(left, right + self.length - 1) > self.corpus.halo:
            raise ValueError("the context is wider than the corpus halo")

    def _fitting(self, arrays: dict[str, Column], i: Column, word: str | None, tag: str | None, window: int) -> Column:
        """The tokens within `window` of the match (not in it) that fit the word and tag patterns."""
        if tag and self.corpus.raw:
            return F.array().cast("array<string>")
        names = ["token", *(["low"] if word else []), *(["tag"] if tag else [])]
        sides = [self.around(arrays[n], i, window, window) for n in names]
        zipped = F.concat(*[F.arrays_zip(*[side[k].alias(n) for n, side in zip(names, sides, strict=True)]) for k in (0, 1)])

        def fits(x: Column) -> Column:
            out = F.lit(True)
            if word:
                out = out & pattern.wildcard(x["low"], word)
            if tag:
                out = out & pattern.any_of(x["tag"], tag)
            return out

        return F.transform(F.filter(zipped, fits), lambda x: x["token"])

    def summary(self, near: str | None = None, near_tag: str | None = None, window: int = 5, per: int = PER_MILLION, by: list[str] | None = None) -> DataFrame:
        """hits, matches (hits that pass the co-occurrence filter), relative frequency of the hits; counted in the block."""
        self._check(window, window)
        if near or near_tag:
            names = ["token", *(["low"] if near else []), *(["tag"] if near_tag else [])]
            passed = self.each(names, lambda a, i: F.size(self._fitting(a, i, near, near_tag, window)) > 0)
        else:
            passed = F.transform(self.found, lambda i: F.lit(True))
        blocks = self.corpus.blocks.select(*(by or []), passed.alias("passed"), "core_len")
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
        counted = blocks.groupBy(*(by or [])).agg(total(F.size("passed"), "hits"), total(F.size(F.filter("passed", lambda p: p)), "matches"), total("core_len", "_size"))
        return counted.withColumn("relative_frequency", stats.relative_frequency(F.col("hits"), F.col("_size"), per)).drop("_size")

    def kwic(
        self, left: int = 7, right: int = 7, near: str | None = None, near_tag: str | None = None, window: int = 5, limit: int | None = 100,
        sample_seed: int | None = None, show_tag: bool = False, show_lemma: bool = False,
    ) -> DataFrame:
        """Concordance lines: unit_id, pos, left, node, right, collocate.

        With a co-occurrence filter, both contexts span its window.  The first `limit` lines in corpus order, or
        the `limit` lines with the smallest md5 of (unit, position, seed); None gives all.

        A limited concordance puts positions in order first and cuts lines out of the blocks of the first `limit` only."""
        active = bool(near or near_tag)
        if active:
            left = right = window
        self._check(left, right)
        if limit is None or limit > FEW_LINES:
            return self._limited(self._lines(left, right, near, near_tag, window, show_tag, show_lemma), limit, sample_seed)
        few = self._limited(self._spots(near, near_tag, window), limit, sample_seed)
        lines = Hits(self.corpus.around(few), self.query)._lines(left, right, near, near_tag, window, show_tag, show_lemma)
        return self._limited(lines, limit, sample_seed)

    @staticmethod
    def _limited(rows: DataFrame, limit: int | None, sample_seed: int | None) -> DataFrame:
        if limit is None:
            return rows
        order = [F.md5(F.concat_ws(":", "unit_id", "pos", F.lit(sample_seed)).cast("binary"))] if sample_seed is not None else []
        return rows.orderBy(*order, "unit_id", "pos").limit(limit)

    def _spots(self, near: str | None, near_tag: str | None, window: int) -> DataFrame:
        """unit_id, pos, first (where the block's own part begins) of the matches that pass the co-occurrence filter."""
        at = self.found
        if near or near_tag:
            names = ["token", *(["low"] if near else []), *(["tag"] if near_tag else [])]
            at = F.filter(self.each(names, lambda a, i: F.when(F.size(self._fitting(a, i, near, near_tag, window)) > 0, i)), lambda i: i.isNotNull())
        rows = self.corpus.blocks.select("unit_id", "start", (F.col("start") + F.col("core_from")).cast("long").alias("first"), F.explode(at).alias("i"))
        return rows.select("unit_id", (F.col("start") + F.col("i")).alias("pos"), "first")

    def _lines(self, left: int, right: int, near: str | None, near_tag: str | None, window: int, show_tag: bool, show_lemma: bool) -> DataFrame:
        names = ["token", "sent", *(["low"] if near else []), *(["tag"] if near_tag or show_tag else []), *(["lemma"] if show_lemma else [])]

        def line(a: dict[str, Column], m: Column) -> Column:
            i = m["i"]
            before, after = self.around(a["token"], i, left, right)
            shown = [self._shown(a, part, show_tag, show_lemma) for part in ((F.greatest(i - left, F.lit(0)), before), (i, F.slice(a["token"], i + 1, F.lit(self.length))), (i + self.length, after))]
            text = [F.array_join(x, " ").alias(name) for name, x in zip(("left", "node", "right"), shown, strict=True)]
            return F.struct(i.alias("i"), *text, m["collocate"].alias("collocate"), F.get(a["sent"], i).alias("sent_id"))

        def lines(*held: Column) -> Column:
            a = dict(zip(names, held, strict=False))
            if near or near_tag:
                fitting = F.transform(held[-1], lambda i: F.struct(i.alias("i"), F.get(self._fitting(a, i, near, near_tag, window), F.lit(0)).alias("collocate")))
                matches = F.filter(fitting, lambda m: m["collocate"].isNotNull())
            else:
                matches = F.transform(held[-1], lambda i: F.struct(i.alias("i"), F.lit("").alias("collocate")))
            return F.transform(matches, lambda m: line(a, m))

        rows = self.corpus.blocks.select("unit_id", *self.corpus.keep, "start", F.explode(once([*[F.col(n) for n in names], self.found], lines)).alias("m"))
        return rows.select("unit_id", *self.corpus.keep, (F.col("start") + F.col("m.i")).alias("pos"), "m.left", "m.node", "m.right", "m.collocate", "m.sent_id")

    @staticmethod
    def _shown(a: dict[str, Column], part: tuple[Column, Column], show_tag: bool, show_lemma: bool) -> Column:
        """Tokens from an index on, as `token/TAG{lemma}`; sentinels are shown as nothing."""
        first, tokens = part
        if not show_tag and not show_lemma:
            return tokens
        visible = lambda x: F.when(x.startswith(UNTAGGED), "").otherwise(x)

        def one(token: Column, k: Column) -> Column:
            parts = [token]
            if show_tag:
                parts += [F.lit("/"), visible(F.get(a["tag"], first + k))]
            if show_lemma:
                parts += [F.lit("{"), visible(F.get(a["lemma"], first + k)), F.lit("}")]
            return F.concat(*parts)

        return F.transform(tokens, one)


def translated(lines: DataFrame, sentences: DataFrame) -> DataFrame:
    """Concordance lines with the translation of their sentence; sentences: unit_id, sent_id, text, and `ordinal` if
    their order is known.  Of several translations of one sentence the last counts (without an order, the greatest)."""
    order = F.struct("ordinal", "text") if "ordinal" in sentences.columns else F.col("text")
    last = sentences.groupBy("unit_id", "sent_id").agg(F.max_by("text", order).alias("translation"))
    joined = lines.join(last, ["unit_id", "sent_id"], "left")
    return joined.withColumn("translation", F.coalesce("translation", F.lit(NO_TRANSLATION)))
