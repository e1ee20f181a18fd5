"""Operators of a training-data pipeline: ten text operators on Spark."""
