"""Columns: number rules, expressions over points, tags."""
