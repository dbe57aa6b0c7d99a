"""Operators for training-data text; nothing outside this package imports it."""
