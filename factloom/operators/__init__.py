"""Operators over fact tables: metrics, comparisons, graphs, datasets, retrieval."""
