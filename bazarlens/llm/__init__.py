"""Operators for preparing training data: near copies, filters, pages, vectors, tokens."""
