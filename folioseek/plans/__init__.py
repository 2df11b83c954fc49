"""Whole flows from tables to tables."""
