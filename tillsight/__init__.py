"""Retail analytics on Spark: profile, clean, and report on transaction data."""
