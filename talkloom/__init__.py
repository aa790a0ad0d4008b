"""Spark jobs over large archives of AI-chat conversations."""
