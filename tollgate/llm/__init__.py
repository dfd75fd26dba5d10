"""Operators for building training data: ten operators and a pipeline over documents, pages and vectors."""
