"""Siftwell: retrieval, ranking and index maintenance as Spark plans."""

__version__ = "0.1.0"
