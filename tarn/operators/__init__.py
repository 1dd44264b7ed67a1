"""DataFrame-to-DataFrame transformations."""

from tarn.operators.pricing import summarize_pricing

__all__ = ["summarize_pricing"]
