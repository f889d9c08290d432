"""Relational operators over long-form fields."""
