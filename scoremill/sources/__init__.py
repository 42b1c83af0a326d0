"""Readers, the landing table and sinks."""
