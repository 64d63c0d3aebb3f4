"""Operators for building language-model training data: text cleaning, deduplication, packing, search."""
