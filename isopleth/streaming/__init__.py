"""Incremental forms of running operators."""
