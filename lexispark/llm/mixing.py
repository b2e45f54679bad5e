"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u)/w, where w is its quality weight; sorted by key, any prefix
of a source is a weighted sample without replacement.  A source's word budget is first spent on complete
epochs, the rest on the prefix of documents whose middle word lies inside the remaining budget, so a source
misses its target by at most half a document.

The prefix is found from totals of key bins and one ordered bin per source, never by sorting a source.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order;
rows with the same id share one key and go by size, those of the same size share one verdict; an empty table gives an empty result; extra columns
stay where the caller's frame has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.prefix import bin_count
from lexispark.llm.storage import Workspace

SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """1 for text without symbol characters, falling as their share grows."""
    chars = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols / chars), F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u)/weight with u in (0, 1) from the md5 of seed and id, so that reruns and SQL agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.log((number.cast("double") + 1.0) / F.lit(float(1 << 52) + 2.0)) / weight


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, weight: Column | None = None, seed: int = 1) -> DataFrame:
    """One narrow row per document: doc_id, source, size, key."""
    text = F.col("text")
    return docs.select(
        "doc_id", "source",
        word_count(text).alias("size"),
        sampling_key(F.col("doc_id"), quality_weight(text) if weight is None else weight, seed).alias("key"),
    )


def budgets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, epochs, rest.  Targets share all words by weight; a target above
    max_epochs times its source is cut there and the excess is shared again by weight.

    With sources in the order of max_epochs * size / weight, exactly the first few are cut, which running
    sums over the sources find without repetition."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("room", F.lit(max_epochs) * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("cut_before", F.coalesce(F.sum(F.lit(max_epochs) * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.sum("source_size").over(everything) - F.col("cut_before"))
        .withColumn("fits", F.col("left") / F.col("weight_from") <= F.col("room"))
        .withColumn("place", F.row_number().over(by_room))
        .withColumn("first_fit", F.min(F.when(F.col("fits"), F.struct("place", "left", "weight_from"))).over(everything))
    )
    target = F.when(F.col("place") < F.col("first_fit.place"), (F.lit(max_epochs) * F.col("source_size")).cast("double")).otherwise(
        F.col("first_fit.left").cast("double") * F.col("weight") / F.col("first_fit.weight_from")
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        ranked.withColumn("target", target).withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("long"))
        .select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    )


def key_bin(bins: int) -> Column:
    """A bin number that rises with the key.  The logarithm of an exponential key has a density under 1/e whatever
    the weight, so a bin holds at most about 1 / (e * bins) of a source's rows."""
    return F.floor(F.log("key") * bins).cast("long")


def plan(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Per source its budget and where its sample ends: documents in bins before cut_bin, and in cut_bin
    those up to `last` (key, id, size), take one epoch more.  Also returns the number of key bins."""
    bins = bin_count(sizes.count())
    goal = work.write(budgets(sizes, weights, max_epochs), "budgets")
    sums = sizes.groupBy("source", key_bin(bins).alias("bin")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ends = sums.withColumn("upto", F.sum("words").over(order))
    cut = (
        ends.join(goal, same(ends, goal)).filter(F.col("upto") > F.col("rest")).groupBy(goal["source"])
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("c"))
        .select("source", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("before"), F.col("c.rest").alias("cut_rest"))
    )
    cut = work.write(cut, "cut_bins")
    inside = Window.partitionBy("cut_source", "cut_bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sizes.withColumn("bin", key_bin(bins)).join(cut.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bin") == F.col("cut_bin")))
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .filter(2 * F.col("start") + F.col("size") <= 2 * F.col("cut_rest"))
        .groupBy("cut_source").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    )
    whole = goal.join(cut.select(F.col("source").alias("s2"), "cut_bin"), F.col("source").eqNullSafe(F.col("s2")), "left").join(last, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return work.write(whole.select("source", "source_size", "target", "epochs", "cut_bin", "last"), "plan"), bins


def copies(rows: DataFrame, source_plan: DataFrame, bins: int) -> DataFrame:
    """Add source_size, target and copies to rows that have source, key, doc_id and size."""
    p = source_plan.withColumnRenamed("source", "plan_source")
    extra = (key_bin(bins) < F.col("cut_bin")) | ((key_bin(bins) == F.col("cut_bin")) & (F.struct("key", "doc_id", "size") <= F.col("last")))
    more = F.when(F.col("cut_bin").isNull(), F.lit(1)).when(F.coalesce(extra, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    at_most = F.when(F.col("epochs") >= MAX_EPOCHS, F.lit(0)).otherwise(more)
    return rows.join(p, F.col("source").eqNullSafe(F.col("plan_source")), "left").withColumn("copies", (F.col("epochs") + at_most).cast("long")).drop("plan_source", "epochs", "cut_bin", "last")


def mix(docs: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, seed: int = 1) -> DataFrame:
    """The documents of the mix, each row repeated as often as it is taken, with the caller's columns."""
    work = Workspace(docs.sparkSession, "mixing")
    sizes = work.write(sized(docs, seed=seed), "sizes")
    source_plan, bins = plan(sizes, work, weights)
    keep = [F.col(f"row.{c}").alias(c) for c in docs.columns]
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key"))
    taken = copies(keyed, source_plan, bins).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*keep)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "mixing")
    sizes = work.write(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    source_plan, bins = plan(sizes, work)
    return copies(sizes, source_plan, bins).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    -ln((CAST(('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 1.0) / 4503599627370498.0)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)), 1.0) AS key
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM per_source),
roomy AS (SELECT *, 3.0::DOUBLE * source_size / w AS room FROM weighted),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY room, source NULLS LAST) AS place,
    (sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_words,
    (sum(w) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_from
  FROM roomy),
fit AS (SELECT place AS p, rest_words AS r, w_from AS f FROM ranked WHERE rest_words::DOUBLE / w_from <= room ORDER BY place LIMIT 1),
goal AS (
  SELECT source, source_size, CASE WHEN place < p THEN (3 * source_size)::DOUBLE ELSE r::DOUBLE * w / f END AS target
  FROM ranked, fit),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM goal),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 3 AND 2 * start + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
