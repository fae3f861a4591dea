"""Reusable DataFrame operators: bounded ranking, rolling means, filters, search."""
