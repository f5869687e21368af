"""Structured Streaming forms of the newest reading and of the flood status."""
