"""Layered profiles over time, as PySpark DataFrames."""

__version__ = "0.1.0"
