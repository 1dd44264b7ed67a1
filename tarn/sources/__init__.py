"""Readers for the input tables."""

from tarn.sources.tables import read_table

__all__ = ["read_table"]
