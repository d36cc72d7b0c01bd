"""Emberline: operational questions over live state and history, as Spark DataFrame jobs."""
