"""Operators of a training-data pipeline, their queries and SQL twins. Nothing else in the library imports this package."""
