"""Column functions: geometry, text, tags and ranking."""
