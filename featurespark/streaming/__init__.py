"""Structured Streaming twins of the feature operators."""
