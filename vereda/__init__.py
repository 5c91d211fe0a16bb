"""Vereda: retrieval and structured-query operators expressed as Spark jobs."""

__version__ = "0.1.0"
