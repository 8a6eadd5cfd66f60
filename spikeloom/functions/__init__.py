"""Column functions for labels, paths and formats."""
