"""Sensitive-content detection, redaction and redaction audit on Spark DataFrames."""
