"""Incremental day-by-day processing with Structured Streaming."""
