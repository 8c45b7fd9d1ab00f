"""Readers of facts and datasets, and staging between steps."""
