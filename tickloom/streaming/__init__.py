"""Stateful checks and aggregates over streams."""
