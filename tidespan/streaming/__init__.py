"""Structured Streaming: ingest, last values, windows, alerts."""
