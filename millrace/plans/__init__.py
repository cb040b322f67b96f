"""Execution control: staged tables, barriers, names, metrics and explain."""
