"""Structured Streaming: updates, their acceptance, and keyed state."""
