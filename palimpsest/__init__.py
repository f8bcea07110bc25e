"""Palimpsest: versioned-document, retrieval and training-data analytics on Apache Spark."""

__version__ = "0.1.0"
