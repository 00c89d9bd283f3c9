"""Interactions as a stream: running counts out of events."""
