"""Structured Streaming: bars from event streams and indicators with state."""
