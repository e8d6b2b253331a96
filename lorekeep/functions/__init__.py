"""Column expressions: text, hashing, time, URL and JSON helpers."""
