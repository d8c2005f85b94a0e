"""Operators for preparing training data: quality, deduplication, privacy, encoding, packing, search."""
