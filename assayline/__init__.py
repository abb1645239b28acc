"""Declarative data quality on Spark DataFrames: checks, contracts, profiles, history."""
