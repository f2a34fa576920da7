"""Streaming aggregation of reader notifications."""
