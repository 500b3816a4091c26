"""Catalogue analytics on PySpark DataFrames."""
