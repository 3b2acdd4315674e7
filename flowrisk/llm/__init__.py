"""Operators for preparing training corpora: sharding, deduplication, tokens, packing."""
