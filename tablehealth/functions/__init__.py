"""Column functions: no function here triggers a shuffle."""
