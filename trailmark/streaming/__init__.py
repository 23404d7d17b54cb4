"""Structured Streaming versions of ingest, identity, sessions and funnel state."""
