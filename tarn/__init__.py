"""Analytics jobs written against the PySpark DataFrame API."""
