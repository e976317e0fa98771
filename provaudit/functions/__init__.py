"""Column functions and distributed ranks."""
