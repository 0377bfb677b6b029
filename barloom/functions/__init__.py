"""Column helpers and distributed series kernels shared by the operators."""
