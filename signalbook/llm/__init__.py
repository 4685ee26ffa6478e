"""Operators of a training-data pipeline, each built by its own method."""
