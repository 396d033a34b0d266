"""Weir: data-pipeline operators for Spark, every one a DataFrame in and a DataFrame out."""

__version__ = "0.1.0"
