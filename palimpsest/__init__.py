"""Palimpsest: reversible anonymisation of text, declared on Spark DataFrames."""

__version__ = "0.1.0"
