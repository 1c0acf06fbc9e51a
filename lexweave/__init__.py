"""Lexical extraction and comparison on Spark DataFrames."""
