"""Structured Streaming variants of the event operators: arriving events, late data, windows, sessions and denial episodes."""
