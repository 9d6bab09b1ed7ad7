"""Operators for preparing training data: finding, scoring, deduplicating and encoding documents."""
