"""Summaries of readings that arrive as a stream."""
