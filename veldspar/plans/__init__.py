"""Plans of the constraint engine."""
