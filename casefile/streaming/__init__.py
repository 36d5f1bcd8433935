"""Structured Streaming jobs over the decision journal."""
