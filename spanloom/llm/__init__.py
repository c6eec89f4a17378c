"""Operators that prepare training text: scoring, filtering, deduplication, encoding, packing."""
