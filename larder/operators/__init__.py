"""Operators on DataFrames that the queries share."""
