"""Relational steps of a reconciliation: each takes and returns DataFrames, lazily."""
