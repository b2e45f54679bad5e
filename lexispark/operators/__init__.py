"""Corpus analyses over blocks; each returns a lazy DataFrame."""
