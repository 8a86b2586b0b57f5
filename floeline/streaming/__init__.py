"""Structured Streaming sources, sinks and incremental runs."""
