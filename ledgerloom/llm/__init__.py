"""Operators for language-model training data."""
