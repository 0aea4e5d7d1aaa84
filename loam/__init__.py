"""Corpus intelligence on Spark: typed DataFrames over files and documents, and operators on them."""
