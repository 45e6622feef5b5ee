"""Readers and writers for event logs and tables."""
