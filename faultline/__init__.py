"""Faultline: an issue ledger for the failing rows of data-quality checks, on Spark."""
