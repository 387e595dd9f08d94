"""Column expressions and small text helpers."""
