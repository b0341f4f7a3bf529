"""Operators of the constraint engine."""
