"""Structured Streaming jobs around the batch operators."""
