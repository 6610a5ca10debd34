"""Stateful per-frame operators on Structured Streaming."""
