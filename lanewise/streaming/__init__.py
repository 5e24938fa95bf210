"""Structured Streaming forms of the track and duplicate operators."""
