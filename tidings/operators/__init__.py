"""Operators over items: each is a function from DataFrames to a DataFrame and runs nothing by itself."""
