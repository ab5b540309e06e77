"""Brindle: graph signatures, retrieval and evaluation as PySpark DataFrames."""

__version__ = "0.1.0"
