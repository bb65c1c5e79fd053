"""Scans, derived tables, written tables and sinks."""
