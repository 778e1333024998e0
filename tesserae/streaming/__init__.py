"""Structured Streaming forms of ingest and event windows."""
