"""Incremental forms of the operators."""
