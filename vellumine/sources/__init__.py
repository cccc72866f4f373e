"""Scans of evidence files, durable tables and sinks."""
