"""Where intermediate tables live: the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BATCH = {"maxRecordsPerBatch": 2000, "maxBytesPerBatch": 8 << 20}  # of what goes to Python: a few MB of text, not tens
BUCKET_BYTES = 32 << 20  # of text, for one Python task of a shuffle


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a single machine (tests) may leave it unset and gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by ARROW_BATCH, so that their memory follows neither the data nor the defaults."""
    for name, most in ARROW_BATCH.items():
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


class Workspace:
    """Names the written tables of one operator call, so that reruns never meet each other's files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/lexispark/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: set[str] = set()

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Cut the lineage of `df`: write it to the shared folder and read it back."""
        path = f"{self.root}/{table}"
        df.write.parquet(path)
        self.tables.add(table)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, table: str) -> DataFrame:
        """A table that was written."""
        return self.spark.read.parquet(f"{self.root}/{table}")

    def drop(self, *tables: str) -> None:
        """Delete written tables that no later step reads."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            path = hadoop(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.tables.discard(table)

    def clear(self, *but: str) -> None:
        """Delete all written tables except those named."""
        self.drop(*(self.tables - set(but)))

    def free(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps, which it does when their plans are collected.  The
        last plan stays with the session until another one runs, so a small one does."""
        self.spark.range(1).count()
        self.spark.sparkContext._jvm.System.gc()


def bucket_count(docs: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, least: int | None = None) -> int:
    """Buckets for a shuffle of what `docs` turns into: one for each `bucket_bytes` of text, and no fewer than the
    session's partitions (or `least` of them, where a bucket's share is small)."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, least or parts), -(-size // bucket_bytes))


def training_row(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
