"""Readers, writers and test-data adapters."""
