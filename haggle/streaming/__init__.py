"""Structured Streaming extension: the negotiation operators over a file
stream of events (no counterpart in the original, which is batch only)."""
