"""Operators of a training-data pipeline: quality, deduplication, privacy, tokens, packing, shards.

Each module is one operator with its own general interface; ``plans`` holds the thin registered
queries. Nothing outside this folder (but the pipeline script) imports it.
"""
