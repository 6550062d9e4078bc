"""Reusable DataFrame operators, written against column parameters."""
