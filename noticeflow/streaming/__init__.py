"""Structured Streaming: polling, delivery, error suppression, dead letters, idle sessions."""
