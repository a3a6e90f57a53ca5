"""Column expressions: formula parsing, weighted terms, statistics."""
