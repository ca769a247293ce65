"""Operators for preparing training data: dedup, quality, tokens, shards, packing, chat and web archives."""
