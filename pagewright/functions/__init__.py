"""Column functions on text and paths."""
