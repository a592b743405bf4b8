"""Readers and parsers at the edges: feeds, pages, lists, model calls."""
