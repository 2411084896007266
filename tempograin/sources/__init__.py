"""Metrics kept as Parquet under one folder, and adapters from tables and JSON."""
