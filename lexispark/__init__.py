"""lexispark: corpus linguistics on Spark DataFrames."""
