"""Operators for preparing text and score collections as training data."""
