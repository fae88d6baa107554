"""Operators for training-data texts. Nothing outside this folder imports it."""
