"""streaming of voltide."""
