"""Readers, writers and the views that give the driver tables a contest shape."""
