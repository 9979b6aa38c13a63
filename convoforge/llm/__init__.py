"""Corpus operators for training-data preparation: deduplication, filtering, tokenising and packing."""
