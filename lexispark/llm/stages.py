"""Operators as pipeline stages: (spark, docs, sf_dir) -> DataFrame with the columns of documents.

Removing stages number the rows and judge each by its own text, whatever its doc_id: a null or repeated id neither
saves nor loses a row.  Of repeated rows the near-duplicate stage keeps one; rows without words are no copies.
Those stages take `stored` for documents that are read from Parquet files as they are: nothing of them is written again.
Empty tables give empty results, null texts have no language and go, extra columns are kept, also those that are named
like an operator's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import contamination, langid, mixing, parity_join, sharding
from lexispark.llm.storage import Workspace

SHINGLE, PERCENT = 5, 80  # near duplicates; op1's own contract has other values
LEAST_SHARE = 0.5  # of a document's letters in its language
BROADCAST_IDS = 1_000_000  # at most about 16 MB of ids


def numbered(docs: DataFrame, work: Workspace, stored: bool) -> tuple[DataFrame, str]:
    """`docs` with a number of its own for every row, which stays the same, and the number's name, which no column of `docs`
    has.  Rows of Parquet files (`stored`) have a file and a place in it, however the files are dealt to tasks; others are
    written with their numbers."""
    row = "_row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row += "_"
    if not stored:
        return work.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row
    place = docs.metadataColumn("_metadata")
    paths = sorted(r[0] for r in docs.select(place["file_path"]).distinct().collect())  # a row for each file goes to every task: the driver's own list
    files = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{row}file long, {row}path string"))
    placed = docs.select("*", place["file_path"].alias(f"{row}path"), place["row_index"].alias(f"{row}index")).join(files, f"{row}path")
    return placed.select(*docs.columns, (F.shiftleft(f"{row}file", 40) + F.col(f"{row}index")).alias(row)), row


def as_documents(rows: DataFrame, row: str) -> DataFrame:
    """Numbered rows for an operator, with the number for the id."""
    return rows.select(F.col(row).alias("doc_id"), "text")


def without(rows: DataFrame, row: str, removed: DataFrame, work: Workspace) -> DataFrame:
    """Numbered rows without those of the given numbers, which are sent to every task only if they are few.  The other written
    tables go."""
    removed = work.write(removed.select(F.col("doc_id").alias(row)), "removed")
    work.clear("rows", "removed")
    few = removed.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(removed) if few else removed, row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language for half of their letters, go."""
    names = [f"kept{i}" for i in range(len(docs.columns))]  # documents may have columns named like the result's
    found = langid.identify(docs.toDF(*names), langid.train(docs), names, text=names[docs.columns.index("text")])
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, stored: bool = False) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard of 0.8 or more, the one with the smallest id stays."""
    work = Workspace(spark, "near-duplicates")
    rows, row = numbered(docs, work, stored)
    groups = work.write(parity_join.ngram_jaccard_groups(as_documents(rows, row), SHINGLE, PERCENT, work, stored=True, links=False, numbered=True), "groups")
    shared = groups.join(groups.filter("doc_id <> component_id").select("component_id").distinct(), "component_id", "left_semi")
    ids = rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    members = work.write(shared.select("doc_id", "component_id").join(ids, "doc_id").select("component_id", "doc_id", place.alias("place")), "shared")
    keepers = members.groupBy("component_id").agg(F.min("place").alias("keeper"))
    return without(rows, row, members.join(keepers, "component_id").filter("doc_id <> keeper.doc_id").select("doc_id"), work)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, stored: bool = False) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    work = Workspace(spark, "decontaminate")
    rows, row = numbered(docs, work, stored)
    found = contamination.contamination(as_documents(rows, row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work=work)
    return without(rows, row, found.filter(F.size("hits") > 0).select("doc_id"), work)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each row as often as it is taken."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return sharding.assign(docs)
