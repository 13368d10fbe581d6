"""Scalar column functions (calendar, labels, coercion, advisory)."""
