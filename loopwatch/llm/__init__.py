"""Operators for large text corpora, built on Spark DataFrames."""
