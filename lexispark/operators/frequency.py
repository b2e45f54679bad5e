"""Corpus overview: sizes, frequency lists, cloud weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import stats
from lexispark.functions.semantics import PER_MILLION, RAW_SHARE, STOPWORDS
from lexispark.functions.text import is_word
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import margins, shared


def summary(corpus: Corpus, by: list[str] | None = None) -> DataFrame:
    """n_tokens (all tokens), n_types (lower-case words), n_lemmas (as they stand, sentinels included).

    Tokens are counted into types in one shuffle; the distinct counts work on those, one column at a time."""
    by = by or []
    types = shared(corpus.counted("low", "lemma", by=by))
    words = types.groupBy(*by, "low").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count_if(is_word(F.col("low"))).alias("n_types"))
    lemmas = types.groupBy(*by, "lemma").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.count_if(F.col("n") > 0).alias("n_lemmas"))
    if not by:
        return words.crossJoin(F.broadcast(lemmas))  # a row each
    renamed = lemmas.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "n_lemmas")
    return words.join(renamed, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]).select(*by, "n_tokens", "n_types", "n_lemmas")


def raw_mode(corpus: Corpus) -> DataFrame:
    return corpus.raw_share().select((F.col("share") > RAW_SHARE).alias("is_raw"), F.round("share", 4).alias("untagged_share"))


def frequency(corpus: Corpus, tagged: bool = False, by: list[str] | None = None, per: int = PER_MILLION, extra_punct: tuple[str, ...] = ()) -> DataFrame:
    """Words (case as written; with their tag if `tagged`), frequency and relative frequency, in the corpus or in each
    group.

    Whether a token is a word is decided on the group's key after counting, once per type.  The size is the sum of the
    counts, so the corpus is read once."""
    by = by or []
    counted = shared(corpus.counted("token", *(["tag"] if tagged else []), by=by).withColumnRenamed("n", "frequency"))
    sized = margins(counted, by, _size="frequency")
    low = F.lower("token")
    word = is_word(low) & (F.col("token") != "")
    kept = sized.filter(word & ~low.isin(*extra_punct) if extra_punct else word)
    return kept.withColumn("relative_frequency", stats.relative_frequency(F.col("frequency"), F.col("_size"), per)).drop("_size")


def frequency_lower(corpus: Corpus, by: list[str] | None = None) -> DataFrame:
    """Case-insensitive counts of every token, punctuation included."""
    return corpus.counted("low", by=by).withColumnsRenamed({"low": "token_low", "n": "frequency"})


def top(freq: DataFrame, limit: int, keys: list[str] | None = None) -> DataFrame:
    """The `limit` most frequent rows with their rank; ties by key.  The rank is given after the limit."""
    keys = keys or ["token"]
    order = [F.desc("frequency"), *keys]
    return freq.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cloud_weights(corpus: Corpus, stopwords: tuple[str, ...] = STOPWORDS, by: list[str] | None = None) -> DataFrame:
    """Weight of each word outside `stopwords`, and its most frequent tag (ties: the first by name)."""
    freq = frequency(corpus, tagged=True, by=by).filter(~F.lower("token").isin(*stopwords) & ~F.col("token").contains(" "))
    best = F.min(F.struct((-F.col("frequency")).alias("f"), "tag"))
    return freq.groupBy(*(by or []), "token").agg(F.sum("frequency").alias("weight"), best["tag"].alias("tag"))
