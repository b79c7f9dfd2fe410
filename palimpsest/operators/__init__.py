"""Operators on the store's tables: indexing, graph, extraction, operations, rerank and evaluation."""
