"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Write a result as Parquet or as CSV with a header, quotes doubled and blanks kept."""
    writer = df.write.mode(mode)
    if format == "csv":
        plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**plain).csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")
