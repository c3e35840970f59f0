"""functions of voltide."""
