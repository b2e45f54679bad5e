"""Quality rules with risk-controlled thresholds.

Each rule is a ratio of a document's own counts, rejecting above a cutoff.  The risk that is controlled is that of
the joint verdict: in each stratum, of the good documents at most a share `risk` is rejected by any rule, with
confidence 1 - delta for all strata together.

The labelled holdout is cut in two halves by a hash of the text.  On the first, cutoffs are tightened one at a time,
always where most bad documents go for each good one; that gives a sequence of settings from lax to strict.  On the
second, the settings are tested in that order by the exact binomial (Clopper-Pearson) upper bound of their rate of
false rejections, at level delta / strata, until one fails: a fixed sequence needs no further correction for the
number of its tests.  The last setting that passed is used; a stratum where the first one fails has no rules.

The holdout is counted in Spark: per stratum, half and label, how many documents exceed how many cutoffs of each rule.
Only these counts reach the driver.  Copies (equal words) count once, as good ones if any label says so.

Strata are classes of length (powers of four of the word count), known for every document.

Defined results: null, empty or blank text has no words and fails the base rule; repeated rows get equal
verdicts; without labels no rule rejects; of several labels of one document the good one counts; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.storage import Workspace

RISK, DELTA = 0.01, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "digest"]
HALVES = 2
_SYMBOLS = b"#*$%&|<>"
_BLANK = b"\t\n\x0b\x0c\r "
_UPPER = bytes(range(65, 91))


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Name -> (ratio, cutoffs from strict to lax)."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return {
        "symbols": (F.col("n_symbols") / chars, [0.01, 0.02, 0.04, 0.08, 0.16, 0.32]),
        "duplicate_lines": (F.col("n_dup_lines") / lines, [0.05, 0.1, 0.2, 0.3, 0.5, 0.7]),
        "repeats": (F.col("n_repeat_words") / words, [0.02, 0.05, 0.1, 0.15, 0.2]),
        "long_words": (F.col("word_chars") / words, [7.0, 8.0, 9.0, 10.0, 12.0, 16.0]),
        "capitals": (F.col("n_upper") / chars, [0.1, 0.2, 0.3, 0.5, 0.7]),
    }


def stratum() -> Column:
    return F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double")) / 2), F.lit(8)).cast("int")


def repeated_words(w: W.Words, window: int) -> np.ndarray:
    """Per document, the words that lie in a window of `window` words found twice or more in its document."""
    out = np.zeros(len(w.per_doc), np.int64)
    n = len(w.hash) - window + 1
    if n <= 0:
        return out
    start = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    if not len(start):
        return out
    h = np.zeros(len(start), np.uint64)
    for j in range(window):
        h = W.mix(h * np.uint64(0x9FB21C651E98DF25) + w.hash[start + j])
    doc = w.doc[start]
    order = np.argsort(W.mix(h + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(start), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, start[twice], 1)
    np.add.at(cover, start[twice] + window, -1)
    return np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=len(out))


def line_counts(text: bytes) -> tuple[int, int]:
    """(lines that hold a word, those of them that equal an earlier line)."""
    if b"\n" not in text:
        return int(bool(text.split(None, 1))), 0
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in W.slices(batch.column(1)):
            w = W.words(s, lower=False)
            repeat = repeated_words(w, WINDOW)
            placed = W.mix(w.hash + (np.arange(len(w.hash)) - w.first[w.doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)))
            digest = (sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64).tolist()
            rows = []
            for d, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
                text = s.data[a:b].tobytes()
                solid = text.translate(None, _BLANK)
                points = len(solid) - int(np.count_nonzero((s.data[a:b] & 0xC0) == 0x80))
                lines, dup = line_counts(text)
                rows.append((int(w.per_doc[d]), points, len(solid) - len(solid.translate(None, _SYMBOLS)), dup, int(repeat[d]), lines, len(solid) - len(solid.translate(None, _UPPER)), digest[d]))
            yield pa.record_batch([batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]], names=["doc_id", *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n still has probability `level`."""
    if n == 0 or k >= n:
        return 1.0

    def below(p: float) -> float:
        log_c, total = 0.0, 0.0
        for i in range(k + 1):
            if i:
                log_c += math.log(n - i + 1) - math.log(i)
            total += math.exp(log_c + i * math.log(p) + (n - i) * math.log1p(-p))
        return total

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > level else (lo, mid)
    return hi


def rejected(exceeded: np.ndarray, setting: list[int], sizes: list[int]) -> np.ndarray:
    """Which rows some rule rejects.  `exceeded` has the number of cutoffs that a row exceeds, per rule; a setting has the
    number of cutoffs in force, counted from the laxest (0: the rule is off)."""
    return (exceeded + np.array(setting) > np.array(sizes)).any(axis=1)


def settings(exceeded: np.ndarray, good: np.ndarray, bad: np.ndarray, sizes: list[int]) -> Iterator[list[int]]:
    """Settings from lax to strict.  Each tightens one rule, to where most bad rows go for each good one."""
    now = [0] * len(sizes)
    out = rejected(exceeded, now, sizes)
    while True:
        best = None
        for r, size in enumerate(sizes):
            for v in range(now[r] + 1, size + 1):
                then = [*now[:r], v, *now[r + 1 :]]
                new = rejected(exceeded, then, sizes) & ~out
                gain = (bad[new].sum() / (good[new].sum() + 0.5), bad[new].sum(), -r, -v)
                if bad[new].sum() and (best is None or gain > best[0]):
                    best = gain, then
        if best is None:
            return
        now = best[1]
        out = rejected(exceeded, now, sizes)
        yield now


def select(exceeded: np.ndarray, counts: np.ndarray, sizes: list[int], risk: float, level: float) -> list[int]:
    """The last setting of the sequence that passes.  `counts` is (rows, half, label): how many holdout documents each
    row of `exceeded` stands for, labels bad and good."""
    passed = [0] * len(sizes)
    total = int(counts[:, 1, 1].sum())
    for setting in settings(exceeded, counts[:, 0, 1], counts[:, 0, 0], sizes):
        wrong = int(counts[rejected(exceeded, setting, sizes), 1, 1].sum())
        if wrong > risk * total or upper_bound(wrong, total, level) > risk:
            break
        passed = setting
    return passed


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """(stratum, rule) -> cutoff."""
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    table = rules()
    exceeded = [reduce(lambda c, x: c + (ratio > x).cast("int"), cutoffs, F.lit(0)).alias(name) for name, (ratio, cutoffs) in table.items()]
    holdout = measured.filter(~base_failed()).select("doc_id", "digest", stratum().alias("stratum"), *exceeded).join(known, "doc_id")
    once = holdout.groupBy("digest", "stratum", *table).agg(F.max("quality").alias("quality")).withColumn("half", F.pmod(F.xxhash64(F.lit(41), "digest"), F.lit(HALVES)))
    rows = once.groupBy("stratum", "half", "quality", *table).count().collect()  # strata x halves x labels x levels of the rules
    sizes = [len(cutoffs) for _, cutoffs in table.values()]
    strata = sorted({r["stratum"] for r in rows})
    found = {}
    for s in strata:
        own = [r for r in rows if r["stratum"] == s and r["quality"] in (0, 1)]
        cells = sorted({tuple(r[name] for name in table) for r in own})
        number = {c: i for i, c in enumerate(cells)}
        counts = np.zeros((len(cells), HALVES, 2), np.int64)
        for r in own:
            counts[number[tuple(r[name] for name in table)], r["half"], r["quality"]] += r["count"]
        setting = select(np.array(cells).reshape(-1, len(sizes)), counts, sizes, risk, delta / len(strata))
        found |= {(s, name): cutoffs[-v] for v, (name, (_, cutoffs)) in zip(setting, table.items(), strict=True) if v}
    return found


def verdicts(measured: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """Add base_failed and kept."""
    rejected = F.lit(False)
    for name, (ratio, _) in rules().items():
        for (s, rule), cutoff in cutoffs.items():
            if rule == name:
                rejected = rejected | ((stratum() == s) & (ratio > cutoff))
    return measured.drop("digest").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, work: Workspace | None = None) -> DataFrame:
    work = work or Workspace(docs.sparkSession, "quality")
    measured = work.write(measure(docs), "measured")
    return verdicts(measured, calibrate(measured, labels, risk, delta))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
