"""Corpus and evaluation analytics on Spark DataFrames."""
