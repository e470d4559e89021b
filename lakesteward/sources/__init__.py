"""Readers, writers and catalog registration."""
