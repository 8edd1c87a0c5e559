"""Column functions: external types, checked casts, index arithmetic."""
