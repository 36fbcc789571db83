"""Operators for training data: duplicates, contamination, language, quality, mixing, pages."""
