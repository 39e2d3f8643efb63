"""Variant interpretation and the table operators around it, on Spark DataFrames."""
