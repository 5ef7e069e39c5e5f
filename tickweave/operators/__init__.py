"""Operators on tick-timed events."""
