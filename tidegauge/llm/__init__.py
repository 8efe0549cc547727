"""Operators of a training-data pipeline: language, quality, duplicates, privacy, tokens, packing, search."""
