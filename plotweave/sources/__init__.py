"""Readers and writers of drawing formats."""
