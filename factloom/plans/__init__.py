"""Logical facts: normalized device tables, and a rule that derives them from business tables."""
