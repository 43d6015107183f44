"""Tidemark: paired and irregular time-series analytics as Spark DataFrame plans."""
