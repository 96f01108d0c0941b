"""Operators for training-data pipelines, each on Spark DataFrames."""
