"""Readers: source registry, feeds, pages, cache, snapshots."""
