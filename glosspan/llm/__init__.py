"""Operators for training-data pipelines: deduplication, filtering, mixing and scoring.

Nothing else in the library imports this subpackage.
"""
