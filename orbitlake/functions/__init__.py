"""Column expressions: geodesy, time and physical models."""
