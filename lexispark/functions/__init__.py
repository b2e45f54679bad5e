"""Column functions: tokenising, statistics, text helpers."""
