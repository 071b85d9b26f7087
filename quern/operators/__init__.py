"""Operators on DataFrames that Spark doesn't offer as one call."""
