"""Column expressions shared by the checks."""
