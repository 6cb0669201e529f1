"""DataFrame operators: pure functions from DataFrames and settings to a lazy DataFrame."""
