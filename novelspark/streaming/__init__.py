"""Structured Streaming versions of the history-dependent scores."""
