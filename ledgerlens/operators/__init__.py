"""Staging, quality, anomaly and interval operators: each maps DataFrames to a DataFrame."""
