"""Scalar Column functions (built-in Spark SQL expressions only)."""
