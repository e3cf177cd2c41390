"""Batch operators on series tables."""
