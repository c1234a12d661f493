"""Operators of a training-data pipeline on document tables. Nothing outside this package imports it."""
