"""NumPy kernels for recurrences and iterative fits: arrays of one series in, arrays or rows out, no Spark."""
