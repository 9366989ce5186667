"""Emberline: analytics over graphs of code and content, as Spark DataFrames."""
