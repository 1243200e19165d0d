"""Column expressions: text, dates, numbers and hashes."""
