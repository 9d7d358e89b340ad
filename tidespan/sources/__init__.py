"""Readers, writers and deterministic test measurements."""
