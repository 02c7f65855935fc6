"""Operators for large training corpora: deduplication, mixing, filtering, tokens, archives, search."""
