"""Operators for training-data corpora, on top of Spark DataFrames."""
