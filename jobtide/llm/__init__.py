"""Operators of a training-data pipeline: tokens, quality, near and exact repeats, language models, packing.

Nothing else in the library imports this package.
"""
