"""The pipeline against brute force on the smallest table."""

import zlib

import corpus_pipeline
from lexispark.llm import langid, mixing, parity_join, stages
from lexispark.llm.contamination import contamination
from lexispark.llm.storage import Workspace

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    work, columns, seen = Workspace(spark, "t"), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = work.write(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())

    before, after = seen["language_id"]
    found = langid.identify(before, langid.train(before), ["doc_id"]).collect()
    assert ids(after) == sorted(r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5)
    before, after = seen["near_duplicates"]
    groups = parity_join.ngram_jaccard_groups(before, stages.SHINGLE, stages.PERCENT).collect()
    assert ids(after) == sorted({r["component_id"] for r in groups})
    before, after = seen["decontamination"]
    found = contamination(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()
    assert ids(after) == sorted(r["doc_id"] for r in found if not r["hits"]) and len(ids(after)) < len(ids(before))
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and ids(after) == ids(mixing.mix(before))
    before, after = seen["sharding"]
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert ids(after) == ids(before) and all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert sum(r["size"] for r in rows) == sum(len(text[i].encode()) + 1 for i in ids(before))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None
