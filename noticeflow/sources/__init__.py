"""Scans, source contracts and sinks."""
