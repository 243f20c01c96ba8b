"""Scalar functions: Column expressions, and the Python kernels behind Arrow functions."""
