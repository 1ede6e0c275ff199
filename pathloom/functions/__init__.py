"""Column functions for log fields and times."""
