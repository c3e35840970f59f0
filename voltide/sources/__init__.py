"""sources of voltide."""
