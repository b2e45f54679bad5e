"""Raw text and vertical (token, tag, lemma per line) sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.semantics import MISSING
from lexispark.functions.text import tokenize
from lexispark.plans.corpus import Corpus

VERTICAL_SHARE = 0.5  # a unit is vertical when more than this share of its lines has three columns


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text files as unit_id (the path) and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("unit_id"), F.col("value").alias("text"))


def _content(line: Column) -> Column:
    """Whether a line's first character that is no space (of any kind) exists and begins no comment."""
    return line.rlike(r"\A\p{Zs}*[^\p{Zs}#]")


def _three(line: Column) -> Column:
    """Whether a line has three columns.  Tabs are counted where there are some: such a line need not be split."""
    trimmed = F.regexp_replace(line, r"\A\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")
    return F.when(line.contains("\t"), F.length(line) - F.length(F.replace(line, F.lit("\t"), F.lit(""))) == 2).otherwise(F.size(F.split(trimmed, r"[ \t\n\f\r]+", 4)) == 3)


def content_lines(text: Column) -> Column:
    """The text's lines without blank lines and #-comments."""
    return F.filter(F.split(text, r"\r?\n"), _content)


def raw_corpus(df: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> Corpus:
    """Blank and comment lines dropped, the rest tokenised; untagged."""
    keep = keep or []
    body = F.array_join(content_lines(F.col(text)), "\n")
    return Corpus.from_arrays(df.select(F.col(id).alias("unit_id"), *keep, tokenize(body).alias("token")), keep, **options)


def columns(line: Column) -> Column:
    """A line's columns: by tabs if there is one, else by white space.  No quoting, no missing-value words."""
    return F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(F.trim(line), r"\s+"))


def vertical_rows(text: Column) -> Column:
    """array<array<string>>: the columns of each line that has a token.  A line is split once."""
    rows = F.transform(F.split(text, r"\r?\n"), columns)
    return F.filter(rows, lambda c: F.get(c, F.lit(0)) != "")


def vertical_arrays(rows: Column) -> list[Column]:
    """token, tag and lemma arrays of split lines; a missing tag or lemma is '###'."""
    part = lambda k: F.transform(rows, lambda c: F.when(F.get(c, F.lit(k)) != "", F.get(c, F.lit(k))).otherwise(MISSING))
    return [F.transform(rows, lambda c: F.get(c, F.lit(0))).alias("token"), part(1).alias("tag"), part(2).alias("lemma")]


def vertical_corpus(df: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> Corpus:
    """One token per line.  Lines keep their order; lines without a token are dropped."""
    keep = keep or []
    split = df.select(F.col(id).alias("unit_id"), *keep, vertical_rows(F.col(text)).alias("rows"))
    return Corpus.from_arrays(split.select("unit_id", *keep, *vertical_arrays(F.col("rows"))), keep, **options)


def detect_format(text: Column, newline: str = r"\r?\n") -> Column:
    """'markup', 'vertical' or 'raw' for one unit, by its own content.  `newline` is what its lines end with."""
    # one pass over the lines: each is told to be left out (null), of three columns or not; text that is markup is not split
    one = F.filter(F.transform(F.split(text, newline), lambda x: F.when(_content(x), _three(x))), lambda t: t.isNotNull())
    counted = F.aggregate(one, F.struct(F.lit(0).alias("n"), F.lit(0).alias("three")), lambda a, t: F.struct((a["n"] + 1).alias("n"), (a["three"] + t.cast("int")).alias("three")), lambda a: (a["n"] > 0) & (a["three"] > VERTICAL_SHARE * a["n"]))
    return F.when(text.rlike(r"\A\p{Zs}*<"), "markup").when(counted, "vertical").otherwise("raw")
