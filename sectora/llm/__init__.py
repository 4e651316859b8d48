"""Operators of a training-data pipeline: cleaning, scoring and tokenising documents."""
