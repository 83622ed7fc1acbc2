"""Longitudinal event analytics on PySpark DataFrames."""
