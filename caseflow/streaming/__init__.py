"""Incremental forms of log statistics on Structured Streaming."""
