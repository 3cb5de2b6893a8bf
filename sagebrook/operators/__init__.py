"""Relational, retrieval, graph and text operators."""
