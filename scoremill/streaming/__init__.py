"""Incremental forms of landing and newest-per-key."""
