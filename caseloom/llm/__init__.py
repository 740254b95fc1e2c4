"""Operators of a training-data pipeline: ten numbered operators and what they share."""
