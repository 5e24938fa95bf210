"""Scans, sinks and the relations derived from the provided tables."""
