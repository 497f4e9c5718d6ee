"""Operators a training-data pipeline needs, on top of the library's general helpers."""
