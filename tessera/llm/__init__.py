"""Operators of a training-data pipeline: deduplication, quality, language, tokens, mixing, archives.

Nothing else in the library imports this package.
"""
