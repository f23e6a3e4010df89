"""Spark jobs for keyed event and market time series."""
