"""Formats and stores of points."""
