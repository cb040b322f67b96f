"""Aggregate, text and validation functions."""
