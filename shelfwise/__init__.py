"""Circulation analytics for library collections, expressed as Spark DataFrames."""

__version__ = "0.1.0"
