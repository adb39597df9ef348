"""Scans, fixtures, prediction files and sinks."""
