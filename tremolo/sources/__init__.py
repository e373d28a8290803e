"""Readers, writers and the shared materialisation folder."""
