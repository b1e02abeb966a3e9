"""Column functions: numbers, contexts, texts, display, vectors."""
