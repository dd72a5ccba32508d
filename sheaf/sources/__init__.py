"""Reads."""
