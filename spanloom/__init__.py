"""Spanloom: interval, token-sequence and versioned-decision analytics on PySpark."""
