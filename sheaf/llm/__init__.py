"""Operators for training data: cleaning, near duplicates, leaks, chat text and tokens."""
