"""Streaming of the constraint engine."""
