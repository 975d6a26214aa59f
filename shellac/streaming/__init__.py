"""Streaming forms of the keyed state (an extension)."""
