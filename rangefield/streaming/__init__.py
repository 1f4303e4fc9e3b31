"""Structured Streaming versions of the state machines."""
