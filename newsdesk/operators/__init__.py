"""Relational operators: deduplication, topics, editorial scoring, classification, reports."""
