"""Operators for preparing training data: dedup, scoring, packing, mixing, token output."""
