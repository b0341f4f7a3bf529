"""Sources of the constraint engine."""
