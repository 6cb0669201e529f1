"""Posting / profile text matching and funnel analytics on Spark DataFrames."""
