"""The training-data pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import stages
from lexispark.llm.storage import Workspace

STAGES = [
    ("language_id", stages.language_id),
    ("near_duplicates", partial(stages.near_duplicates, stored=True)),
    ("decontamination", partial(stages.decontaminate, stored=True)),
    ("mixing", stages.mix_sources),
    ("sharding", stages.shard),
]

#: SQL has no counterpart of the learned language model, so the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
