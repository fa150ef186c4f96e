"""Observation synthesis and flow routing on Spark DataFrames."""

__version__ = "0.1.0"
