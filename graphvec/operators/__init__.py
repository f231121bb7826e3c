"""Queries, traversals, vector search and transactions."""
