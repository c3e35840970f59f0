"""operators of voltide."""
