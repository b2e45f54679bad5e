"""Dictionary entries: forms of a word's lemmas, frequency bands, lexicon look-ups, related forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import stats
from lexispark.functions.semantics import MISSING, NO_LEVEL, PER_MILLION, UNTAGGED
from lexispark.functions.text import dictionary_link
from lexispark.operators.search import Hits
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import margins, shared


def forms(corpus: Corpus, word: str, per: int = PER_MILLION, by: list[str] | None = None) -> DataFrame:
    """Distinct (token, tag, lemma), lower-cased, of all tokens that share a lemma with `word` (in the corpus or in the
    group); frequency of each token whatever its case, relative frequency, Zipf score and band.  A word that occurs
    without a usable lemma gives one untagged row.

    Tokens are counted into types in one shuffle; everything after works on those."""
    by, low = by or [], word.lower()
    types = shared(corpus.counted("low", "tag", "lemma", by=by))
    names = {c: f"_by{k}" for k, c in enumerate(by)}
    renamed = [F.col(c).alias(n) for c, n in names.items()]
    same = lambda: [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    usable = ~F.col("lemma").isin(UNTAGGED, MISSING)
    own = types.filter(F.col("low") == low)
    lemmas = own.filter(usable).groupBy(*by, "lemma").agg(F.sum("n").alias("_n")).select(*renamed, F.col("lemma").alias("_lemma"))
    sharing = types.join(lemmas, [F.col("lemma") == F.col("_lemma"), *same()]).groupBy(*by, F.col("low").alias("token"), "tag", F.lower("lemma").alias("lemma")).agg(F.sum("n").alias("_n"))
    untagged = F.lit(UNTAGGED)
    fallback = own.groupBy(*by).agg(F.sum("n").alias("_n"), F.count_if(usable).alias("with_lemma")).filter("_n > 0 AND with_lemma = 0")
    rows = sharing.drop("_n").unionByName(fallback.select(*by, F.lit(low).alias("token"), untagged.alias("tag"), untagged.alias("lemma")))
    totals = margins(types.groupBy(*by, "low").agg(F.sum("n").alias("frequency")), by, _size="frequency").select(*renamed, F.col("low").alias("_low"), "frequency", "_size")
    out = rows.join(totals, [F.col("token") == F.col("_low"), *same()])  # every form is a type
    out = out.withColumn("relative_frequency", stats.relative_frequency(F.col("frequency"), F.col("_size"), per)).withColumn("zipf", stats.zipf(F.col("relative_frequency")))
    return out.select(*by, "token", "tag", "lemma", "frequency", "relative_frequency", "zipf", stats.zipf_band(F.col("zipf")).alias("band"))


def with_lexicon(rows: DataFrame, lexicon: DataFrame, column: str) -> DataFrame:
    """Add `column` of a lexicon table (word, ...); words it lacks get NA.  Spark picks the join by size."""
    entry = lexicon.groupBy(F.col("word").alias("token")).agg(F.min(column).alias(column))
    return rows.join(entry, "token", "left").withColumn(column, F.coalesce(column, F.lit(NO_LEVEL)))


def entry(corpus: Corpus, word: str, lexicon: DataFrame, lang: str = "en", per: int = PER_MILLION) -> DataFrame:
    rows = with_lexicon(with_lexicon(forms(corpus, word, per), lexicon, "cefr"), lexicon, "ipa")
    return rows.withColumn("link", dictionary_link(F.col("token"), F.lit(lang)))


def view(corpus: Corpus, word: str, lexicon: DataFrame, lang: str = "en", examples: int = 5, width: int = 7) -> DataFrame:
    """The whole dictionary page as rows (part, token, detail): the forms with tag, lemma, level, transcription and
    link; the related forms; the first example lines."""
    forms_ = entry(corpus, word, lexicon, lang).select(F.lit("form").alias("part"), "token", F.concat_ws(" | ", "tag", "lemma", "cefr", "ipa", "link").alias("detail"))
    others = related(corpus, word).select(F.lit("related").alias("part"), "token", F.lit("").alias("detail"))
    lines = Hits(corpus, word).kwic(width, width, limit=examples).select(F.lit("example").alias("part"), F.col("node").alias("token"), F.concat_ws(" | ", "left", "right").alias("detail"))
    return forms_.unionByName(others).unionByName(lines)


def related(corpus: Corpus, word: str) -> DataFrame:
    """Distinct tokens that contain `word`, ignoring case, but for the word itself."""
    low = word.lower()
    return corpus.counted("token").filter(F.contains(F.lower("token"), F.lit(low)) & (F.lower("token") != low)).select("token")


def word_tags(corpus: Corpus, word: str) -> DataFrame:
    """Tags and usable lemmas of a word, sorted."""
    rows = corpus.counted("low", "tag", "lemma").filter(F.col("low") == word.lower())
    lemma = F.when(~F.col("lemma").isin(UNTAGGED, MISSING), F.col("lemma"))
    packed = rows.groupBy(F.col("low").alias("token")).agg(F.array_sort(F.collect_set("tag")).alias("t"), F.array_sort(F.collect_set(lemma)).alias("l"))
    return packed.select("token", F.array_join("t", ",").alias("tags"), F.array_join("l", ",").alias("lemmas"))


def tagset(corpus: Corpus) -> DataFrame:
    return corpus.counted("tag").filter(~F.col("tag").isin(UNTAGGED, MISSING)).withColumnRenamed("n", "frequency")
