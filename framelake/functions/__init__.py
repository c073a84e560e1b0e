"""Column builders and per-image kernels."""
