"""Structured Streaming jobs: intake, audit log, current state, audit rate."""
