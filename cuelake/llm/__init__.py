"""Operators of a training-data pipeline: dedup, mixing, quality, licences, HTML, tokens."""
