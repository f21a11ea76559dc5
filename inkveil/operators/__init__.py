"""Operators over the relational text layer."""
