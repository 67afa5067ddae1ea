"""Accounting operators, generic over the tables that carry their columns."""
