"""Relational and time-series operators: DataFrames in, DataFrames out, nothing collected."""
