"""Readers, writers and pipeline state."""
