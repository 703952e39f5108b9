"""Cadence: cyclic hourly time-series analytics as plain Spark DataFrame plans."""
