"""Scoring a stream of target rows against static reference lookups."""
