"""Readers and the table catalogue."""
