"""Spark-native curation, mixing and evaluation engine for instruction-edit data."""

__version__ = "0.1.0"
