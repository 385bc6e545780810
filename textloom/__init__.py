"""Spark-first analytics for large multi-source text corpora."""

from textloom.session import get_spark

__all__ = ["get_spark"]
