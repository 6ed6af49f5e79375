"""Lodestar: code-audit analytics on PySpark."""
