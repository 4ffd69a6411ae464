"""Operators for preparing language-model training data: tokens, formatting, packing, filtering and deduplication."""
