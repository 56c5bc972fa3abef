"""Operators: DataFrame to DataFrame, columns by name."""
