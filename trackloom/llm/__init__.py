"""Operators for preparing training text: deduplication, filters, privacy, mixing."""
