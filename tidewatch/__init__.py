"""Anomaly analytics for large collections of keyed time series, on PySpark."""
