"""Structured Streaming front."""
