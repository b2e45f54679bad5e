"""Markup structure: which attributes with which values occur on which tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is no element: comments, CDATA sections, processing instructions, declarations, also those with a subset.
OTHER = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>\[]*(?:\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]\s*)?>"
#: A start tag.  A quoted value may hold anything but its quote, also '>'.
START_TAG = r"""<[\p{L}_:][^\s<>/="']*(?:\s(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)?>|<[\p{L}_:][^\s<>/="']*/>"""
NAME = r"""<([^\s<>/="']+)"""
#: Name, then the value in one of the two kinds of quotes.
ATTRIBUTE = r"""\s([\p{L}_:][^\s<>/="']*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
#: The entities that markup defines by itself; the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
REFERENCE = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"
BUCKETS = 1024  # in which the values of one attribute are ordered apart


def decoded(value: Column) -> Column:
    """The value with its character references and entities as characters; references to no character stay."""
    digits = lambda r: F.regexp_extract(r, r"([0-9A-Fa-f]+);", 1)
    code = lambda r: F.when(r.rlike("^&#[xX]"), F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("int")
    real = lambda c: ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF))
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    refs = F.array_distinct(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0)))
    known = F.aggregate(refs, value, lambda v, r: F.replace(v, r, F.when(real(code(r)), char(code(r))).otherwise(r)))
    value = F.when(value.contains("&#"), known).otherwise(value)
    for name, symbol in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(symbol))
    return value


def attributes(markup: Column) -> Column:
    """array<struct<tag, attr, value>> from the start tags; a tag without attributes has one null attribute."""
    tags = F.regexp_extract_all(F.regexp_replace(markup, OTHER, " "), F.lit(START_TAG), F.lit(0))

    def of(tag: Column) -> Column:
        name = F.regexp_extract(tag, NAME, 1)
        group = lambda k: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k))
        pairs = F.arrays_zip(group(1).alias("attr"), group(2).alias("double"), group(3).alias("single"))
        none = F.array(F.struct(name.alias("tag"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("value")))
        found = F.transform(pairs, lambda p: F.struct(name.alias("tag"), p["attr"].alias("attr"), decoded(F.concat(p["double"], p["single"])).alias("value")))
        return F.when(F.size(pairs) > 0, found).otherwise(none)

    return F.flatten(F.transform(tags, of))


def structure(df: DataFrame, markup: str, max_values: int = 20) -> DataFrame:
    """tag, attr, n_values (distinct) and values: the first `max_values` of them by name, comma-joined.

    An attribute's values are dealt into buckets by their hash; each bucket makes them distinct, counts them and keeps its
    smallest, and these few are merged, so no task sees all values of an attribute.  Markup need not be well-formed."""
    found = df.select(F.explode(F.array_distinct(attributes(F.col(markup)))).alias("a")).select("a.*", F.pmod(F.xxhash64("a.value"), F.lit(BUCKETS)).alias("bucket"))
    rows = found.repartition("tag", "attr", "bucket").distinct()
    rank = F.row_number().over(Window.partitionBy("tag", "attr", "bucket").orderBy("value"))
    ranked = rows.withColumn("rank", rank)
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= max_values, F.col("value")))), 1, max_values)
    return ranked.groupBy("tag", "attr").agg(F.count("value").alias("n_values"), F.array_join(first, ",").alias("values"))


def merged(frames: list[tuple[DataFrame, str]], max_values: int = 20) -> DataFrame:
    """The structure of several corpora together."""
    rows = [df.select(F.col(markup).alias("markup")) for df, markup in frames]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return structure(out, "markup", max_values)
