"""Scalar functions: Column in, Column out, no UDF."""
