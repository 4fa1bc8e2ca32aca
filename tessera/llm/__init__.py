"""Operators of a large training-data pipeline; nothing outside this folder imports it."""
