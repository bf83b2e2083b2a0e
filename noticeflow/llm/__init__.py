"""Operators for preparing training data: deduplication, scoring, mixing, fingerprints, tokens, chats, archives."""
