"""Column functions: tokenising, ranking arithmetic, display."""
