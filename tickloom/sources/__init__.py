"""Readers, writers and the adapter from event tables."""
