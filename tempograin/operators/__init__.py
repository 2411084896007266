"""Operators over points: ingest, coalescing, aggregation, histograms, statistics."""
