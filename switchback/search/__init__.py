"""Plain NumPy kernels for one request's graph or profile; no Spark imports."""
