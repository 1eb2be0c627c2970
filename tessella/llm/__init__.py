"""Operators for preparing training data: filters, duplicates, tokens, search, packing."""
