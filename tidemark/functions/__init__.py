"""Scalar functions: geodesy, satellite bands, dates and tail probabilities."""
