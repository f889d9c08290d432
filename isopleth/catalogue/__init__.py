"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from . import access, calculus, features, metadata, reductions, selection, spectra, statistics, waves  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
