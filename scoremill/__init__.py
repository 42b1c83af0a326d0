"""Evaluation score tables, suites and data-mix accounting on Spark DataFrames."""
