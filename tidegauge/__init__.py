"""Time-series analytics on PySpark."""
