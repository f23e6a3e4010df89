"""Readers of landed snapshot files and writers of results."""
