"""Registered queries: one Spark plan and one DuckDB twin per operator."""
