"""Corpus statistics as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.semantics import NOT_SIGNIFICANT, PER_MILLION, SIGNIFICANCE, ZIPF_BANDS


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """2 * sum of k ln(k/e) over the cells where both k and its expectation e are positive; 0 for an empty table.

    Overlapping windows can make k12 negative; such a cell is left out, as its logarithm has no value."""
    total = k11 + k12 + k21 + k22
    rows, cols = (k11 + k12, k21 + k22), (k11 + k21, k12 + k22)
    out = F.lit(0.0)
    for k, r, c in ((k11, 0, 0), (k12, 0, 1), (k21, 1, 0), (k22, 1, 1)):
        e = rows[r].cast("double") * cols[c] / total
        out = out + F.when((k > 0) & (e > 0), k * F.ln(k / e)).otherwise(0.0)
    return F.when(total == 0, 0.0).otherwise(2 * out)


def mutual_information(k11: Column, node_freq: Column, coll_total: Column, corpus_size: Column) -> Column:
    """log2 of observed over expected; 0 where either is 0."""
    expected = node_freq.cast("double") * coll_total / corpus_size
    return F.when((k11 == 0) | (expected == 0), 0.0).otherwise(F.log2(k11 / expected))


def significance(ll: Column) -> Column:
    out = F.lit(NOT_SIGNIFICANT)
    for least, mark in reversed(SIGNIFICANCE):
        out = F.when(ll >= least, mark).otherwise(out)
    return out


def relative_frequency(freq: Column, size: Column, per: int = PER_MILLION) -> Column:
    return F.round(freq / size * per, 4)


def zipf(per_million: Column) -> Column:
    """log10(per million) + 3 with two decimals; null for 0."""
    return F.round(F.when(per_million > 0, F.log10(per_million) + 3), 2)


def zipf_band(score: Column) -> Column:
    out = F.lit(5)
    for least, band in reversed(ZIPF_BANDS):
        out = F.when(score >= least, band).otherwise(out)
    return out


def direction(left: Column, right: Column) -> Column:
    """The side with more occurrences: R, L, or B for a tie."""
    return F.when(right > left, "R").when(left > right, "L").otherwise("B")
