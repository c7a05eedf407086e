"""Operators for preparing training data: scoring, near copies, extraction, mixing, filters, tokens and search."""
