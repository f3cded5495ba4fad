"""Operators over graphs, histories and matrices. Each takes frames and returns frames."""
