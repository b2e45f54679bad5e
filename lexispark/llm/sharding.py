"""Sharding by balanced label propagation, with DataFrame operations only.

Documents are linked where their texts are equal.  The documents of such a group are interchangeable, so the
state of the propagation is one count per (group, shard): a group that holds a third of all rows is at most
`shards` rows.  In each round a group's documents ask to move to the shard that already holds most of the
group and has room; requests are granted at the rate that the quotas allow: what flows back the other way,
and the shard's free capacity.  Afterwards every shard keeps its linked documents up to an equal share of all
bytes, and the rest (single documents, overflow) fills the remaining room in one running order, which leaves
each shard within one document of its share.

The law is `bytes`.  Defined results: null text has size 1 and crc 0 and links like an empty text; repeated
rows are documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.prefix import bin_count, running_total, uniform
from lexispark.llm.storage import Workspace

SHARDS = 16
ROUNDS = 5
GROUP = ["group_hash", "text_crc32", "size"]


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_hash"),
    )


def propagate(state: DataFrame, capacity: float, shards: int, seed: int) -> DataFrame:
    """One round over (group, shard, n): requests, quotas, moves."""
    room = state.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load"))
    every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = every.join(room, "shard", "left").select("shard", (F.lit(capacity) - F.coalesce(F.col("load"), F.lit(0))).alias("free"))
    held = state.join(F.broadcast(room), "shard")  # one row per shard
    # the fullest shard of the group that has room; ties fall to a hash so that they do not all pick shard 0
    choice = F.max(F.when(F.col("free") > F.col("size"), F.struct("n", F.xxhash64("group_hash", "shard").alias("tie"), "shard")))
    held = held.join(state.join(F.broadcast(room), "shard").groupBy(*GROUP).agg(choice.alias("best")), GROUP)
    asks = (F.col("best").isNotNull()) & (F.col("shard") != F.col("best.shard")) & (F.struct("n", F.xxhash64("group_hash", "shard")) < F.struct("best.n", "best.tie"))
    asked = held.withColumn("to", F.when(asks, F.col("best.shard")))
    demand = asked.filter("to IS NOT NULL").groupBy("shard", "to").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"))
    back = demand.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("bytes").alias("back"))
    into = demand.groupBy("to").agg(F.sum("bytes").alias("all_in")).join(room.withColumnRenamed("shard", "to"), "to")
    quota = F.least(F.col("bytes"), F.coalesce(F.col("back"), F.lit(0))) + F.greatest(F.col("free"), F.lit(0.0)) * F.col("bytes") / F.col("all_in")
    rates = demand.join(back, ["shard", "to"], "left").join(into, "to").select("shard", "to", F.least(F.lit(1.0), quota / F.col("bytes")).alias("rate"))
    moved = asked.join(F.broadcast(rates), ["shard", "to"], "left")  # one row per pair of shards
    # whole documents; the fraction left over is granted by a fair coin of the group
    share = F.col("n") * F.coalesce(F.col("rate"), F.lit(0.0))
    moved = moved.withColumn("go", F.least(F.col("n"), F.floor(share + uniform(F.col("group_hash"), F.col("shard"), seed=seed))).cast("long"))
    stay = moved.select(*GROUP, "shard", (F.col("n") - F.col("go")).alias("n"))
    go = moved.filter("to IS NOT NULL").select(*GROUP, F.col("to").alias("shard"), F.col("go").alias("n"))
    return stay.unionByName(go).filter("n > 0").groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"))


def keep_within(state: DataFrame, capacity: float, rows: int) -> DataFrame:
    """What each shard keeps of its linked documents: the largest groups first, up to `capacity` bytes."""
    bins = bin_count(rows)
    ordered = state.select(
        *GROUP, "shard", "n", (F.col("n") * F.col("size")).alias("bytes"),
        F.floor(-F.log2(F.col("n").cast("double"))).alias("b1"), F.floor(uniform(F.col("group_hash")) * bins).alias("b2"),
    )
    placed = running_total(ordered, ["shard"], ["b1", "b2"], GROUP, "bytes", "start")
    fits = F.greatest(F.lit(0), F.floor((F.lit(capacity) - F.col("start")) / F.col("size")))
    return placed.select(*GROUP, "shard", F.least(F.col("n"), fits).cast("long").alias("n"), "bytes").filter("n > 0")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, work: Workspace | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of `docs`."""
    work = work or Workspace(docs.sparkSession, "sharding")
    base = work.write(measured(docs), "base")
    total = base.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    capacity, bins = total["bytes"] / shards, bin_count(total["rows"])

    start = F.floor(uniform(F.col("doc_id"), seed=3) * shards).cast("int")
    state = base.groupBy(*GROUP, start.alias("shard")).agg(F.count("*").alias("n"))
    linked = Window.partitionBy(*GROUP)
    state = work.write(state.withColumn("all", F.sum("n").over(linked)).filter("all > 1").drop("all"), "state0")
    for k in range(rounds):
        state = work.write(propagate(state, capacity, shards, seed=100 + k), f"state{k + 1}")
    kept = work.write(keep_within(state, capacity, state.count()), "kept")

    # per group: its shards and up to which rank of the group's documents each one keeps
    upto = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = kept.withColumn("upto", F.sum("n").over(upto)).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    groups = state.groupBy(*GROUP).agg(F.lit(True).alias("linked"))
    groups = groups.join(ends, GROUP, "left")
    doc_bins = base.withColumn("u", uniform(F.col("doc_id"), seed=5)).withColumn("b", F.floor(F.col("u") * bins)).withColumn("one", F.lit(1))
    # written, so that a hot group's join may be split and its ranks are dealt out by bin, not by group
    members = work.write(doc_bins.join(groups, GROUP, "left"), "members")
    linked_docs = running_total(members.filter("linked"), GROUP, ["b"], ["u", "doc_id"], "one", "rank")
    place = F.get(F.filter("ends", lambda e: e["upto"] > F.col("rank")), F.lit(0))
    linked_docs = linked_docs.withColumn("shard", place["shard"])
    single = members.filter("linked IS NULL").withColumn("rank", F.lit(0).cast("long")).withColumn("shard", F.lit(None).cast("int"))
    columns = ["doc_id", "size", "text_crc32", "group_hash", "u", "rank", "shard"]
    both = work.write(linked_docs.select(*columns).unionByName(single.select(*columns)), "placed")
    work.drop("members", "kept", *[f"state{k}" for k in range(rounds + 1)])

    # everything without a shard fills the room that is left, copies next to each other
    loads = {r["shard"]: r["b"] for r in both.filter("shard IS NOT NULL").groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    filler = both.filter("shard IS NULL").drop("shard").withColumn("b1", F.floor(uniform(F.col("group_hash"), seed=7) * bins)).withColumn("b2", F.floor(F.col("rank") / bins))
    filler = running_total(filler, [], ["b1", "b2"], ["group_hash", "text_crc32", "size", "rank", "u", "doc_id"], "size", "start")
    middle = F.col("start") + F.col("size") / 2
    edges, x = [], 0.0
    for j in range(shards - 1):
        x += capacity - loads.get(j, 0)
        edges.append(x)
    chosen: Column = reduce(lambda c, e: c + F.when(middle >= F.lit(e), 1).otherwise(0), edges, F.lit(0))
    filler = filler.withColumn("shard", chosen.cast("int"))
    final = ["doc_id", "size", "text_crc32", "u", "shard"]
    done = both.filter("shard IS NOT NULL").select(*final).unionByName(filler.select(*final))
    done = done.withColumn("b", F.floor(F.col("u") * bins)).withColumn("one", F.lit(1))
    return running_total(done, ["shard"], ["b"], ["u", "doc_id", "text_crc32", "size"], "one", "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op8_balanced_shards(spark, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
