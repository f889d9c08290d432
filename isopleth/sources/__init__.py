"""Readers, writers, generators and grids made from tables."""
