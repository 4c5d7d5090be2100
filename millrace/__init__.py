"""Everyday and iterative data jobs, and dataset-reuse analysis, as Spark DataFrames."""
