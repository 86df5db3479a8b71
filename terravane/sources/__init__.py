"""Readers and Python data sources."""
