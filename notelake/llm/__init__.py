"""Operators for preparing training data. Optional: nothing outside this folder imports it."""
