"""Scans, routing and sinks."""
