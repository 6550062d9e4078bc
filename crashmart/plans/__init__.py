"""Whole data flows: projection, key vault, warehouse, reports, profiles, quality and release."""
