"""Operators: DataFrame in, DataFrame out, nothing collected on the way."""
