"""Structured Streaming forms of the reference's windows, arcs and hourly files."""
