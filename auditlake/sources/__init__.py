"""Readers, writers and wire shapes."""
