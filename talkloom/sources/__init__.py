"""Readers of exports and archives, and writers of what the jobs make."""
