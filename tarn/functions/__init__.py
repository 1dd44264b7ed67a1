"""Column expressions shared by the operators."""

from tarn.functions.exact import rounded_sum

__all__ = ["rounded_sum"]
