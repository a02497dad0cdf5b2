"""Incremental intake of listings."""
