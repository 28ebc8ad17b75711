"""Structured Streaming counterparts of the log audit and validation."""
