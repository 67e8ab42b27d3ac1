"""Relational, document, vector, graph and table operators."""
