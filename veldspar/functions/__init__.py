"""Functions of the constraint engine."""
