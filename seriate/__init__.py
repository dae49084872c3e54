"""Ordered-column analytics on Spark: running and moving vector functions, order-aware grouping and data cleaning operators."""

__version__ = "0.1.0"
