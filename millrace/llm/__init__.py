"""Operators for training data: percentiles, token ids, mixing, subjects."""
