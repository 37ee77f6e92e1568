"""Relational forms of chunking, indexing, retrieval, evaluation and comparison."""
