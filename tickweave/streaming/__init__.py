"""Structured Streaming forms of the operators."""

from .windows import closed_window_stream

__all__ = ["closed_window_stream"]
