"""Operators of a training-data pipeline: text quality, deduplication, mixing, tokens and models over documents."""
