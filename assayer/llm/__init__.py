"""Operators of a training-data pipeline: text selection, duplicates, archives, packing and counts."""
