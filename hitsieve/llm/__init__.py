"""Operators of a training-data pipeline: derivatives, tokens, mixing, deduplication, quality."""
