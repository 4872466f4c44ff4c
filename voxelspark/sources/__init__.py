"""Readers, writers and volumes derived from the driver tables."""
