"""Operators on tables of snapshots: each takes and returns DataFrames."""
