"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lexispark.llm.clustering import OP13_SQL, op13_centroid_clustering
from lexispark.llm.contamination import op10_benchmark_decontamination
from lexispark.llm.langid import op3_language_id
from lexispark.llm.licenses import OP12_SQL, op12_license_scan
from lexispark.llm.lm import op2_lm_scoring
from lexispark.llm.mixing import OP5_SQL, op5_mix_sources
from lexispark.llm.parity_join import op1_ngram_jaccard_join
from lexispark.llm.quality import op6_quality_rules
from lexispark.llm.secrets import op9_secret_scan
from lexispark.llm.sharding import op8_balanced_shards
from lexispark.llm.substrings import op4_substring_dedup
from lexispark.llm.toxicity import op7_toxicity
from lexispark.llm.whitening import op11_embedding_whitening

OPERATORS = (
    op1_ngram_jaccard_join, op2_lm_scoring, op3_language_id, op4_substring_dedup, op5_mix_sources, op6_quality_rules, op7_toxicity, op8_balanced_shards, op9_secret_scan,
    op10_benchmark_decontamination, op11_embedding_whitening, op12_license_scan, op13_centroid_clustering,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": OP5_SQL, "op12_license_scan": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
