"""Column functions: time, status, labels and window statistics."""
