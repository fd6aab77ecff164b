"""Operators for training data: packing, filters, deduplication, archives, search."""
