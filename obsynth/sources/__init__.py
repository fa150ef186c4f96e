"""Readers and writers of the project's tables."""
