"""Structured Streaming forms: sessions, barrier-limited merging with state, latest versions, resumable work."""
