"""Readers of the engine."""
