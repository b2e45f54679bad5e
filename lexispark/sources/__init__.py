"""Readers that turn text, vertical files, markup and pairs into token arrays."""
