"""Snapshot, RSS, cache and statistics writers."""
