"""Readers, writers and dataset tables."""
