"""Column functions: the scalar language, quoting, and text helpers."""
