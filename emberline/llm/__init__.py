"""Operators for preparing training text: deduplication, scanning, scoring, archives, tokens."""
