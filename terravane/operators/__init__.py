"""Operators over areas, requests and registers."""
