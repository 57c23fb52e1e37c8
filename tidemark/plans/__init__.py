"""Registered queries: each operator over whole tables, with SQL for DuckDB where SQL can express it."""
