"""Operators over catalogue snapshots."""
