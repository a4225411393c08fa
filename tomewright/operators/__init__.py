"""Operators from DataFrame to DataFrame: chunking, vectors, retrieval, generation, evaluation, relational tables."""
