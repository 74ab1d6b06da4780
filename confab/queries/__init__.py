"""Queries over the driver tables and their DuckDB twins, by family."""
