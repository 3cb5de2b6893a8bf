"""Column expressions and the Python kernels behind the Arrow functions."""
