"""Operators: take DataFrames, return DataFrames, never collect."""
