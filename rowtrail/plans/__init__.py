"""Queries that put the operators together, and reports over result tables."""
