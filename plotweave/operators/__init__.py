"""Composable DataFrame operators over drawing tables."""
