"""Registered queries of the feed engine, each with its SQL oracle."""
