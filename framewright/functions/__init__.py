"""Column functions: exact time arithmetic, bits, bytes and array kernels."""
