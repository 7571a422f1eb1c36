"""Operators of a training-data pipeline: packing, extraction, token files, deduplication and classifiers."""
