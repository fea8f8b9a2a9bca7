"""Ledger-style transaction analytics as Spark DataFrame operations."""
