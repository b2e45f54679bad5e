"""Cutting a plan: a table that several later steps read is written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  Only a single machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, int]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 4 << 20) -> AbstractContextManager[None]:
    """While an action of ours runs, batches for Python hold so many rows and bytes at most; then the session's own
    settings hold again."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size})


def open_writers(spark: SparkSession, most: int = 16) -> AbstractContextManager[None]:
    """While an action of ours writes a partitioned table, a task keeps a file open for each of up to `most` partitions; only
    beyond that it sorts (and spills) the rows that are left by partition."""
    return _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": most})


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """For lazy results, whose action is not ours: bound the session's batches for Python, if they may be larger."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written folder that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """`df`, written to the shared folder as Parquet and read from there ever after.

    For tables of units, which are far smaller than the tokens they are counted from.  A lost executor costs a reread,
    not a recount; later steps read the columns that they need."""
    path = f"{scratch(df.sparkSession)}/lexispark/cut-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(df: DataFrame) -> DataFrame:
    """An aggregate that several parts of one result read, lazily: its shuffle is made once.

    Spark reuses a shuffle only where all its readers plan it alike, but a reader's filter or choice of columns would be
    pushed below the aggregate.  An observed checksum of all columns keeps both above it."""
    return df.observe(f"shared-{uuid.uuid4().hex[:12]}", F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"))


def margins(df: DataFrame, by: list[str], **sums: str) -> DataFrame:
    """`df` with sums over all of its rows, or over the rows of each group: margins(df, ["lang"], total="n")."""
    whole = df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])
    if not by:
        return df.crossJoin(F.broadcast(whole))  # one row
    names = {c: f"_by{k}" for k, c in enumerate(by)}
    renamed = whole.select(*[F.col(c).alias(n) for c, n in names.items()], *sums)
    return df.join(renamed, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())
