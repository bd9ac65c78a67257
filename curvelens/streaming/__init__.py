"""Watching growing logs with Structured Streaming."""
