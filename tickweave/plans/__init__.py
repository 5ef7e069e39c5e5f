"""Whole queries: tempo map, meter map, frames, dedup."""
