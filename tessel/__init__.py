"""Curation of image, caption and text training data on Spark: DataFrames in, DataFrames out."""
