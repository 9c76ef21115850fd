"""Patch mining and text datasets on Spark DataFrames."""

__version__ = "0.1.0"
