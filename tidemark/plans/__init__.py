"""Catalogs, accounting and validation."""
