"""Scalar functions of the time-series layer, all as built-in expressions."""
