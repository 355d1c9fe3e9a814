"""Workflows, registered queries, their DuckDB twins and parameters."""
