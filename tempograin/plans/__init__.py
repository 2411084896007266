"""Compositions of aggregates, and the choice of a granularity."""
