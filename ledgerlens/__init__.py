"""Subscription and usage analytics as PySpark DataFrame operators."""
