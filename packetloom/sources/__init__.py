"""Scans, sinks and table adapters."""
