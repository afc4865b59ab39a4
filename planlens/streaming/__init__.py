"""Structured Streaming: newly arriving sets and the job stream."""
