"""Readers and writers of transaction data."""
