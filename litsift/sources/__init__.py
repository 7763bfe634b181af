"""Scans, sinks and small config tables."""
