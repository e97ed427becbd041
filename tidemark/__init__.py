"""Tidemark: place, rule and time-series analytics expressed as Spark DataFrame jobs."""
