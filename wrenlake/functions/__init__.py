"""Column functions: text and time parsing, vectors."""
