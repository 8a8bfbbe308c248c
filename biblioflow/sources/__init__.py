"""Readers for tables, listings, raw documents and archives."""
