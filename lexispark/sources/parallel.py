"""Sentence-aligned corpora: a table of pairs, or two sides with sentence ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import tokenize
from lexispark.operators.search import Hits, translated
from lexispark.plans.corpus import Corpus
from lexispark.sources.markup import markup_corpus, sentences


def alignment(source: DataFrame, target: DataFrame) -> DataFrame:
    """Sentences that one side lacks: unit_id, sent_id, missing_in.  Empty when the sides are aligned."""
    s = source.select("unit_id", "sent_id").distinct().withColumn("in_source", F.lit(True))
    t = target.select("unit_id", "sent_id").distinct().withColumn("in_target", F.lit(True))
    both = s.join(t, ["unit_id", "sent_id"], "full_outer")
    missing = F.when(F.col("in_source").isNull(), "source").when(F.col("in_target").isNull(), "target")
    return both.select("unit_id", "sent_id", missing.alias("missing_in")).filter("missing_in IS NOT NULL")


@dataclass
class ParallelCorpus:
    """Source side as a corpus, target side as sentences (unit_id, sent_id, ordinal, text)."""

    source: Corpus
    sentences: DataFrame

    @classmethod
    def from_pairs(cls, df: DataFrame, unit: str, sent: str, src: str, tgt: str, order: str | None = None) -> ParallelCorpus:
        """One row per sentence pair; source sentences are joined per unit in order of their ids (and of `order`, which
        also tells which of several pairs with one id is the last)."""
        rank = F.col(order) if order else F.lit(0)
        rows = df.select(F.col(unit).alias("unit_id"), F.col(sent).cast("long").alias("sent_id"), rank.cast("long").alias("ordinal"), tokenize(F.col(src)).alias("token"), F.col(tgt).alias("text"))
        with_sent = rows.withColumn("sent", F.array_repeat(F.col("sent_id"), F.size("token")))
        packed = with_sent.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "ordinal", "token", "sent"))).alias("s"))
        flat = [F.flatten(F.col(f"s.{a}")).alias(a) for a in ("token", "sent")]
        return cls(Corpus.from_arrays(packed.select("unit_id", *flat)), rows.select("unit_id", "sent_id", "ordinal", "text"))

    @classmethod
    def from_markup(cls, source: DataFrame, target: DataFrame, id: str = "doc_id", markup: str = "markup") -> ParallelCorpus:
        """Two marked-up sides with the same unit ids; sentences correspond by their ids.  `unaligned` tells what
        one side lacks; such source sentences have no translation."""
        sides = [sentences(df, id, markup) for df in (source, target)]
        corpus = cls(markup_corpus(source, id, markup), sides[1].select("unit_id", "sent_id", "ordinal", "text"))
        corpus.unaligned = alignment(*sides)
        return corpus

    def target(self) -> Corpus:
        """The target side as a corpus of its own, to be searched like the source."""
        rows = self.sentences.filter("text IS NOT NULL").withColumn("token", tokenize(F.col("text")))
        packed = rows.withColumn("sent", F.array_repeat(F.col("sent_id"), F.size("token"))).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "ordinal", "token", "sent"))).alias("s"))
        return Corpus.from_arrays(packed.select("unit_id", *[F.flatten(F.col(f"s.{a}")).alias(a) for a in ("token", "sent")]))

    def summary(self) -> DataFrame:
        """Aligned sentences and source tokens."""
        return self.source.tokens("sent").agg(F.count_distinct("unit_id", "sent").alias("n_sentences"), F.count("*").alias("n_tokens"))

    def kwic(self, query: str, **options) -> DataFrame:
        return translated(Hits(self.source, query).kwic(**options), self.sentences)
