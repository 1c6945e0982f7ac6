"""Column functions: text, personal data, similarity."""
