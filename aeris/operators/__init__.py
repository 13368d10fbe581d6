"""Relational, ordered, statistical and model operators."""
