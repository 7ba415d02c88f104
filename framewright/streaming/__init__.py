"""Bounded reordering, reference state and windows on Structured Streaming."""
