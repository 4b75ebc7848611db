"""Operators of a training-data pipeline: deduplication, search, tokens, quality, mixing, sharding, chat.

Each module is one operator with a general interface; ``queries`` holds the thin registered
queries over the test tables. Nothing outside this package imports it.
"""
