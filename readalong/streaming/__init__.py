"""Incremental processing of pages."""
