"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle each."""
