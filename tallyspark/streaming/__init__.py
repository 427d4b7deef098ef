"""Structured Streaming jobs over tool events and journals."""
