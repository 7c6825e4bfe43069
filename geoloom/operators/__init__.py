"""Operators over layers: each takes layers or DataFrames and returns a DataFrame."""
