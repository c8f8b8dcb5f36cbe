"""Retail analytics, data-quality, result-comparison and text-similarity jobs on Spark DataFrames."""
