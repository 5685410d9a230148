"""Operators for training-data pipelines: cleaning, deduplicating, tokenizing, packing and sharding a corpus."""
