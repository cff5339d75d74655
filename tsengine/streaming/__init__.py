"""Structured Streaming ingest and downsampling."""
