"""Structured Streaming entry points for revenue file drops."""
