"""Whole computations: extraction, comparison of documents, claim graphs."""
