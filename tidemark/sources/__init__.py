"""Readers of landed payloads and adapters of stored tables."""
