"""Whole queries, from the source tables to the result."""

from tarn.plans.pricing_summary import PRICING_SUMMARY_SQL, pricing_summary

__all__ = ["PRICING_SUMMARY_SQL", "pricing_summary"]
