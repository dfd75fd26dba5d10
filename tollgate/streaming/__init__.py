"""Structured Streaming forms of reply ingest and of routing."""
