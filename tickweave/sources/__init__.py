"""Readers that give events, tempo and meter changes."""
