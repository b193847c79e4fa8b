"""Column functions: line grammar and categories."""
