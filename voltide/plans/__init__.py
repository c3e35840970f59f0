"""plans of voltide."""
