"""Operators on series and feature tables."""
