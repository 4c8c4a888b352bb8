"""Scalar functions: native column expressions, and Arrow functions where Spark has none."""
