"""Corpus layout (blocks with halo) and the search-pattern builder."""
