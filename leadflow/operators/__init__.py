"""Operators: DataFrame in, DataFrame out, always lazy."""
