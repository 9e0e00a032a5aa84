"""Structured Streaming form of the landed-page source."""
