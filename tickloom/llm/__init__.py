"""Operators for training-corpus preparation; nothing outside this subpackage imports it."""
